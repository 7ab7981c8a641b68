"""Personal data: fixed patterns, secrets, and terms that give the found entities away.

Everything here is DataFrame and SQL functions.  Base spans come from four
patterns; secrets are long tokens whose characters carry many bits.  What is
protected is each value found (an address, a number, a key) and each kind: a
word may name one person, or say that a number is somebody's key.  Every word
of a document that holds an entity is a candidate; over the whole corpus the
pointwise mutual information of term t and entity e, all counts by document,

    PMI(t, e) = log2(N * df(t, e) / (df(t) * df(e))),

is compared with the information that e itself carries, IC(e) = log2(N / df(e)).
Where PMI / IC reaches REMOVE, the term all but names the entity and is removed.
From GENERALISE on it is replaced by the longest of its prefixes (`zorb*`,
`zo*`) that does not itself reach GENERALISE for an entity of the document, and
by [TERM] where each does.

Copies are no evidence.  Texts are told apart by a sketch, the least hash of
their words, which near copies mostly share; a pair counts where the sketches of
its documents are worth EVIDENCE different texts (inverse Simpson index).

The patterns are written so that the engine never scans a run twice: possessive
quantifiers, and look-behinds in place of retries inside a run.  They find the
same leftmost non-overlapping matches as the plain patterns do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import free_name, prepare, read_table, saved, small_side

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # only whole chains of 13 to 19 digits: a chain is consumed at once, so its parts never match
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?+[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    SECRET: r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
#: A secret changes so often between letters and digits and has so many bits: its length times the entropy of its characters.
SECRET_CHANGES, SECRET_BITS = 4, 64
#: Shares of an entity's information content from which a term is generalised or removed.
GENERALISE, REMOVE = 0.6, 0.85
#: Different texts that the documents of a pair must be worth: for a value, and for a kind, which has many more terms to meet by chance.
EVIDENCE, KIND_EVIDENCE = 1.8, 4.0
#: Lengths of the prefixes that a term may be generalised to.
LEVELS = (4, 2)
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Tables of terms or documents are broadcast up to this many rows (under 64 MB); beyond, the joins shuffle.
BROADCAST_ROWS = 200_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a correct check digit."""
    values = F.split(F.reverse(digits), "")
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def secret_bits(token: Column) -> Column:
    """Length times the entropy of the token's characters."""
    size = F.length(token).cast("double")
    count = lambda c: size - F.length(F.replace(token, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise(count(c) * F.log2(size / count(c))))


def _valid(kind: Column, found: Column) -> Column:
    n = F.length(_digits(found))
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    changes = F.regexp_count(found, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ip)
        .when(kind == "card", n.between(13, 19) & luhn(_digits(found)))
        .when(kind == SECRET, (changes >= SECRET_CHANGES) & (secret_bits(found) >= SECRET_BITS))
        .otherwise(n.between(9, 15))
    )


def _found(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """All matches of a pattern with the length of the gap before each."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, F.lit(pattern), -1)
    row = lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(s["before"]).alias("gap"), s["hit"].alias("hit"))
    found = F.filter(F.transform(F.arrays_zip(hits.alias("hit"), gaps.alias("before")), row), lambda s: s["hit"].isNotNull())
    return F.when(guard, found).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string>>"))


def _placed(rows: DataFrame) -> DataFrame:
    """Start and end in code points of exploded matches (id, h, kind, i, gap, hit, ...)."""
    size = F.length("hit")
    before = Window.partitionBy("id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0)) + F.col("gap")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + size)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, kind, start, end, hit): valid matches of the patterns, secrets among them; h is a hash of the text."""
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.col("text").contains("@"), "ip": digit, "card": digit, "phone": F.col("text").contains("+"), SECRET: digit}
    found = F.concat(*[_found(F.col("text"), k, p, guards[k]) for k, p in PATTERNS.items()])
    # rows repeated in full give the same matches once
    rows = _texts(docs, id_col, text_col).where(digit | guards["email"]).select("id", "h", F.explode(found).alias("f")).select("id", "h", "f.*").distinct()
    return _placed(rows).where(_valid(F.col("kind"), F.col("hit"))).drop("i", "gap")


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _prefixes(words: Column, size: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > size), lambda w: F.concat(F.left(w, F.lit(size)), F.lit("*")))


def _with_prefixes(words: Column) -> Column:
    return F.array_distinct(F.concat(words, *[_prefixes(words, n) for n in LEVELS]))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """The join condition of two tables of documents, the second with t_id and t_h."""
    return a["id"].eqNullSafe(b["t_id"]) & (a["h"] == b["t_h"])


def _other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"id": "t_id", "h": "t_h"})


def _worth(groups: DataFrame, *keys: str) -> DataFrame:
    """Of rows (keys, sketch): how many there are (n) and how many different texts their sketches are worth."""
    one = groups.groupBy(*keys, "sketch").agg(F.count("*").alias("n"))
    return one.groupBy(*keys).agg(F.sum("n").alias("n"), (F.pow(F.sum("n"), F.lit(2.0)) / F.sum(F.col("n") * F.col("n"))).alias("worth"))


def disclosing_terms(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(id, h, term, action, put): the terms of a document that give away an entity of it, and what replaces them."""
    rows, n = spans.count(), float(docs.count())
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("hit"))).when(F.col("kind") == SECRET, F.col("hit")).otherwise(F.lower("hit"))
    held = F.explode(F.array(F.struct(F.concat_ws(":", "kind", value).alias("entity"), F.lit(EVIDENCE).alias("least")), F.struct(F.col("kind").alias("entity"), F.lit(KIND_EVIDENCE).alias("least"))))
    holders = saved(spans.select("id", "h", held.alias("e")).select("id", "h", "e.*").distinct(), 2 * rows, 20_000)
    named = saved(holders.select("id", "h").distinct(), rows, 20_000)
    n_named = named.count()
    some = _other(F.broadcast(named) if n_named <= BROADCAST_ROWS else named)
    texts = _texts(docs, id_col, text_col)
    # columns of their own before they are exploded: an expression beside a generator would be worked out for each of its rows
    words = texts.join(some, _same(texts, some), "left_semi").select("id", "h", words_of(F.col("text")).alias("words")).dropDuplicates(["id", "h"])
    sketch = F.coalesce(F.array_min(F.transform("words", lambda w: F.xxhash64(w))), F.lit(0))
    # stored: joined to entities, and asked for its vocabulary
    words = words.select("id", "h", sketch.alias("sketch"), "words").checkpoint()
    words = words.select("id", "h", "sketch", F.explode(_with_prefixes(F.col("words"))).alias("term"))
    # documents of one sketch are worth one text, whatever the entity
    terms = saved(words.groupBy("term").agg((F.min("sketch") < F.max("sketch")).alias("differ")).where("differ").select("term"), rows, 1_000)
    n_terms = terms.count()
    every = texts.select(words_of(F.col("text")).alias("words")).select(F.explode(_with_prefixes(F.col("words"))).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        df_t = every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df_t"))
    else:
        df_t = every.groupBy("term").agg(F.count("*").alias("df_t")).join(terms, "term")
    df_t = saved(df_t, n_terms)
    entities = saved(holders.groupBy("entity").agg(F.count("*").alias("df_e")), rows)
    holders = holders.join(small_side(entities, entities.count(), 100), "entity").withColumnsRenamed({"id": "t_id", "h": "t_h"})
    information = F.log2(F.lit(n) / F.col("df_e"))
    # df(t, e) is at most the lesser of both counts: frequent words never reach the threshold, and are paired with no entity
    most = F.log2(F.lit(n) * F.least("df_t", "df_e") / (F.col("df_t") * F.col("df_e")))
    known = words.join(small_side(df_t, n_terms, 60), "term")
    pairs = known.join(holders, _same(known, holders)).where((most >= generalise * information) & (F.col("df_e") > 1)).select("id", "h", "sketch", "entity", "least", "df_e", "term", "df_t").checkpoint()
    share = F.log2(F.lit(n) * F.col("n") / (F.col("df_t") * F.col("df_e"))) / F.greatest(information, F.lit(1e-9))
    judged = _worth(pairs, "entity", "least", "df_e", "term", "df_t").where(F.col("worth") >= F.col("least")).withColumn("share", share).where(F.col("share") >= generalise)
    told = pairs.join(judged.select("entity", "term", "share"), ["entity", "term"]).groupBy("id", "h", "term").agg(F.max("share").alias("share"))
    told = told.groupBy("id", "h").agg(F.collect_list(F.struct("term", "share")).alias("told"))
    open_ = F.transform(F.filter("told", lambda t: t["term"].endswith("*")), lambda t: t["term"])
    put = lambda w: F.coalesce(*[F.when((F.length(w) > k) & ~F.array_contains(open_, F.concat(F.left(w, F.lit(k)), F.lit("*"))), F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in LEVELS], F.lit("[TERM]"))
    gone = lambda t: t["share"] >= remove
    acts = F.transform(
        F.filter("told", lambda t: ~t["term"].endswith("*")),
        lambda t: F.struct(t["term"].alias("term"), F.when(gone(t), "removed").otherwise("generalised").alias("action"), F.when(gone(t), "").otherwise(put(t["term"])).alias("put")),
    )
    return told.select("id", "h", F.explode(acts).alias("a")).select("id", "h", "a.*")


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, start, end, action, put) of every occurrence of its disclosing terms in a document."""
    named = saved(terms.select("id", "h").distinct())
    some = _other(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named)
    texts = _texts(docs, id_col, text_col)
    texts = texts.join(some, _same(texts, some), "left_semi").dropDuplicates(["id", "h"])
    found = _placed(texts.select("id", "h", F.explode(_found(F.col("text"), "term", TERM, F.lit(True))).alias("f")).select("id", "h", "f.*"))
    acts = _other(terms)
    return found.join(acts, _same(found, acts) & (F.lower("hit") == F.col("term"))).select("id", "h", "start", "end", "action", "put")


MARKS = "array<struct<start:bigint,end:bigint,action:string,put:string>>"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base, secrets, terms) of every document that has a span.

    base is a sorted array of (k, start, end, kind); secrets of (start, end) and
    terms of (start, end, action, put) leave out what overlaps a base span, and
    terms what overlaps a secret.  Null and empty texts have no span; texts of
    any length are read whole; rows repeated in full share one result row, other
    rows of one id, or of none, are told apart by their texts; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    spans = spans_of(docs, id_col, text_col).checkpoint()
    terms = saved(disclosing_terms(docs, spans, id_col, text_col), spans.count(), 5_000)
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    own = F.sort_array(F.collect_list(F.when(F.col("kind") != SECRET, F.struct(place.alias("k"), "start", "end", "kind"))))
    hidden = F.sort_array(F.collect_list(F.when(F.col("kind") == SECRET, F.struct("start", "end"))))
    clear = lambda array, of: F.filter(array, lambda t: ~F.exists(of, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    base = spans.groupBy("id", "h").agg(own.alias("base"), hidden.alias("secrets")).withColumn("secrets", clear("secrets", "base"))
    if terms.select("term").first() is None:
        return base.withColumn("terms", F.array().cast(MARKS))
    told = _other(term_spans(docs, terms, id_col, text_col).groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "action", "put"))).alias("terms")))
    both = base.join(told, _same(base, told), "left")
    return both.select("id", "h", "base", "secrets", clear(clear(F.coalesce("terms", F.array().cast(MARKS)), "base"), "secrets").alias("terms"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with base spans and secrets replaced by their kind in brackets, terms generalised or cut out."""
    spans = sanitise(docs, id_col, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    on = docs[id_col].eqNullSafe(spans["id"]) & (F.xxhash64(text) == spans["h"])
    marks = free_name(docs, "__marks")
    mark = lambda s, put: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), put.alias("put"))
    every = F.concat(
        F.transform(spans["base"], lambda b: mark(b, F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")))),
        F.transform(spans["secrets"], lambda b: mark(b, F.lit(f"[{SECRET.upper()}]"))),
        F.transform(spans["terms"], lambda t: mark(t, t["put"])),
    )
    rows = docs.join(spans, on, "left").select(*[docs[c] for c in docs.columns], F.sort_array(every).alias(marks))
    text = F.coalesce(F.col(text_col), F.lit(""))
    state = lambda at, out: F.struct(at.cast("long").alias("at"), out.alias("out"))

    def put(s: Column, m: Column) -> Column:
        # of overlapping spans the first is replaced and the rest of the others goes with it
        fresh = m["start"] >= s["at"]
        gap = F.when(fresh, F.substr(text, s["at"] + 1, m["start"] - s["at"])).otherwise(F.lit(""))
        return state(F.greatest(s["at"], m["end"]), F.concat(s["out"], gap, F.when(fresh, m["put"]).otherwise(F.lit(""))))

    done = F.aggregate(F.col(marks), state(F.lit(0), F.lit("")), put, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return rows.select(*[F.when(F.col(marks).isNotNull(), done).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op6_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document; n_private counts base spans and secrets."""
    docs = read_table(spark, sf_dir, "documents")
    found = sanitise(docs).withColumnsRenamed({"id": "s_id", "h": "s_h"})
    listed = lambda array, kind: F.coalesce(F.array_join(F.transform(array, lambda b: F.concat_ws(":", kind(b), b["start"], b["end"])), ","), F.lit(""))
    base = listed("base", lambda b: b["kind"])
    more = F.concat_ws(",", F.nullif(listed("secrets", lambda b: F.lit(SECRET)), F.lit("")), F.nullif(listed("terms", lambda b: F.lit("term")), F.lit("")))
    count = lambda kind: F.coalesce(F.size(F.filter("base", lambda b: b["kind"] == kind)), F.lit(0)).cast("long")
    act = lambda action: F.coalesce(F.size(F.filter("terms", lambda t: t["action"] == action)), F.lit(0)).cast("long")
    size = lambda array: F.coalesce(F.size(array), F.lit(0)).cast("long")
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = keys.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.when(more == "", base).when(base == "", more).otherwise(F.concat_ws(",", base, more)).alias("spans"),
        size("secrets").alias("n_secret"), act("removed").alias("n_removed"), act("generalised").alias("n_generalised"), (size("base") + size("secrets")).alias("n_private"),
    )
