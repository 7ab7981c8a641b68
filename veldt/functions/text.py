"""Text functions: normalising, term overlap, edit distance and vocabulary tokens."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Options of the normaliser, in the order in which they apply.
OPTIONS = ("TEXT_LOWER2UPPER", "TEXT_UPPER2LOWER", "TEXT_SBC2DBC", "TEXT_CHT2CHS", "TEXT_FILTER", "TEXT_SPLITCHRS", "TEXT_REMOVE_SPACE")
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def normalise(c: Column, options: list[str], traditional: str = "", simplified: str = "", max_length: int | None = None, stop_chars: str = "") -> Column:
    """Apply normaliser options; the traditional and simplified characters are a parameter, position by position."""
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    steps = {
        "TEXT_LOWER2UPPER": F.upper,
        "TEXT_UPPER2LOWER": F.lower,
        "TEXT_SBC2DBC": lambda x: F.translate(x, FULL_WIDTH, HALF_WIDTH),
        "TEXT_CHT2CHS": lambda x: F.translate(x, traditional, simplified) if traditional else x,
        "TEXT_FILTER": lambda x: F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}\s]", ""),
        "TEXT_SPLITCHRS": lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(\p{IsHan})", " $1 "), r" {2,}", " ")),
        "TEXT_REMOVE_SPACE": lambda x: F.regexp_replace(x, r"\s", ""),
    }
    if max_length is not None:
        c = F.left(c, F.lit(max_length))
    out = reduce(lambda x, o: steps[o](x) if o in options else x, OPTIONS, c)
    return F.translate(out, stop_chars, "") if stop_chars else out


def _position(query: Column, title: Column) -> Column:
    """First place (from 0) at which title holds query as a contiguous run, null if none."""
    starts = F.when(F.size(title) >= F.size(query), F.sequence(F.lit(0), F.size(title) - F.size(query))).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.filter(starts, lambda i: F.slice(title, i + 1, F.size(query)) == query))


def _places(query: Column, title: Column) -> Column:
    """Places of the query's distinct terms in the title, in order: array of (place, term)."""
    terms = F.array_distinct(query)
    at = F.transform(title, lambda t, i: F.struct(i.alias("place"), t.alias("term")))
    return F.filter(at, lambda s: F.array_contains(terms, s["term"]))


def _cover(query: Column, title: Column) -> Column:
    """Length of the shortest part of the title with all of the query's terms; 0 if one is missing."""
    terms, places = F.array_distinct(query), _places(query, title)
    # the shortest cover starts at a match: for each, the farthest of the terms' next places
    ends = F.transform(places, lambda s: F.array_max(F.transform(terms, lambda t: F.coalesce(F.array_min(F.transform(F.filter(places, lambda p: (p["term"] == t) & (p["place"] >= s["place"])), lambda p: p["place"])), F.lit(1 << 30)))) - s["place"] + 1)
    best = F.array_min(ends)
    return F.when(best < (1 << 29), best).otherwise(0).cast("double")


def _distances(query: Column, title: Column) -> Column:
    """Distances between places of different query terms in the title."""
    places = _places(query, title)
    pairs = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: (b["place"] > a["place"]) & (b["term"] != a["term"])), lambda b: b["place"] - a["place"])))
    return pairs


def overlap(query: Column, title: Column, method: str) -> Column:
    """How a query's terms (array<string>) occur in a title's.

    The proximity methods measure over all places of different query terms; with
    no such pair the distances are the title's length plus one.  An empty or
    null side gives 0.
    """
    shared, missing = F.size(F.array_intersect(query, title)).cast("double"), (F.size(title) + 1).cast("double")
    found = {
        "query_common_ratio": lambda: shared / F.size(F.array_distinct(query)),
        "title_common_ratio": lambda: shared / F.size(F.array_distinct(title)),
        "is_contain": lambda: F.when(_position(query, title).isNotNull(), 1.0).otherwise(0.0),
        "is_equal": lambda: F.when(query == title, 1.0).otherwise(0.0),
        "index_of": lambda: F.coalesce(_position(query, title), F.lit(-1)).cast("double"),
        "proximity_min_cover": lambda: _cover(query, title),
        "proximity_min_dist": lambda: F.coalesce(F.array_min(_distances(query, title)).cast("double"), missing),
        "proximity_max_dist": lambda: F.coalesce(F.array_max(_distances(query, title)).cast("double"), missing),
        "proximity_avg_dist": lambda: F.coalesce(F.try_divide(F.aggregate(_distances(query, title), F.lit(0.0), lambda a, x: a + x), F.size(_distances(query, title)).cast("double")), missing),
    }
    if method not in found:
        raise ValueError(f"unknown overlap method {method!r}")
    return F.when((F.size(query) > 0) & (F.size(title) > 0), found[method]()).otherwise(F.lit(0.0))


def edit_distance(a: Column, b: Column, encoding: str = "utf-8") -> Column:
    """Levenshtein distance in code points, or in bytes for encoding latin."""
    if encoding == "latin":
        a, b = (F.decode(x.cast("binary"), "ISO-8859-1") for x in (a, b))
    return F.levenshtein(a, b)


def greedy_tokens(c: Column, vocabulary: dict[str, int], unknown: int = 0) -> Column:
    """Ids of a text by greedy longest match, white space apart; in SQL functions, for vocabularies that fit in a plan.

    Words are matched by one alternation, longest entries first, any other
    character being the unknown token.
    """
    entries = sorted(vocabulary, key=lambda w: (-len(w), w))
    quoted = ["\\Q" + w + "\\E" for w in entries]
    pattern = "|".join([*quoted, r"\S"])
    table = F.create_map(*[F.lit(x) for w in entries for x in (w, vocabulary[w])])
    return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), lambda t: F.coalesce(table[t], F.lit(unknown)))


def token_ids(path: str):
    """A function of array<string> that gives array<array<int>>: the ids of each text by the tokenizer stored at `path`.

    The file is a tokenizers JSON or, with the ending .model, a sentencepiece
    model; the driver reads it and its bytes travel with the function.
    """
    with open(path, "rb") as f:
        spec = f.read()
    sentences = path.endswith(".model")

    @pandas_udf("array<array<int>>")
    def ids(texts: pd.Series) -> pd.Series:
        if sentences:
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_proto=spec).encode
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(spec.decode())
            encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        return texts.map(lambda own: None if own is None else [None if t is None else list(encode(t)) for t in own])

    return ids
