"""Secrets: fixed patterns, and long tokens judged by who else in the corpus has them.

Everything here is DataFrame and SQL functions.  Values that look like secrets
are candidates: what is assigned to a password or token, access keys, long
hexadecimal runs, and any other long token that changes often between letters
and digits and carries many bits.  Over the whole corpus the hashes of their
values are counted by repository and owner.  A value that many owners have was
copied from documentation: it is an example.  One that few owners have is their
own and, where it carries enough bits, looks live.  Tokens of the last kind are
secrets only where they look live; the others always are, with their verdict.

Counting goes from (value, owner, repository) to (value, owner) to value, each
summed up before it is shuffled, so that a value in a third of all documents is
a few rows a task.

As in `sanitise`, patterns never scan a run twice: look-behinds start a run at
its first character, possessive quantifiers take it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sanitise import secret_bits
from .session import prepare, read_table, saved, small_side

#: Kinds in the order of their spans; the last is the one that owners decide.
KINDS = ("assign", "access", "hex", "token")
WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: A token has so many characters, runs of letters and of digits, and bits: its length times the entropy of its characters.
TOKEN_LENGTH, TOKEN_MOST, TOKEN_RUNS, TOKEN_BITS = 20, 512, 5, 64
#: Values of more owners are examples; other values of so many bits look live.
MOST_OWNERS, LIVE_BITS = 2, 40
LIVE, EXAMPLE, WEAK = "live", "example", "weak"


def _either_case(word: str) -> str:
    """A pattern for a word with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_TOKEN = "[A-Za-z0-9+/_=-]"
PATTERNS = {
    "assign": rf"""({"|".join(map(_either_case, WORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # all of a run of capitals and digits is one match, so a short one holds no longer one
    "access": rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}+",
    "hex": rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}+",
    "token": rf"(?<!{_TOKEN}){_TOKEN}{{{TOKEN_LENGTH},}}+",
}


def matches(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """All matches of a pattern, each with its number and the length of the gap before it; none where the guard is false."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, F.lit(pattern), -1)
    row = lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(s["before"]).alias("gap"), s["hit"].alias("hit"))
    found = F.filter(F.transform(F.arrays_zip(hits.alias("hit"), gaps.alias("before")), row), lambda s: s["hit"].isNotNull())
    return F.when(guard, found).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """(id, h, owner, repo, kind, start, end, value, bits): matches of all kinds, owners not yet asked; h and value are hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), own(owner_col).alias("owner"), own(repo_col).alias("repo"), text.alias("text"))
    low = F.lower("text")
    words = [low.contains(w) for word in WORDS for w in {word.replace("?", ""), word.replace("_?", "")}]
    named = words[0]
    for w in words[1:]:
        named = named | w
    # every long hexadecimal run lies in a token's run
    rows = rows.select("*", named.alias("assign"), F.col("text").contains("AKIA").alias("access"), F.col("text").rlike(PATTERNS["token"]).alias("long"))
    guards = {"assign": F.col("assign"), "access": F.col("access"), "hex": F.col("long"), "token": F.col("long")}
    found = F.concat(*[matches(F.col("text"), k, PATTERNS[k], guards[k]) for k in KINDS])
    keys = ["id", "h", "owner", "repo"]
    # rows repeated in full give the same matches once
    rows = rows.where("assign or access or long").select(*keys, F.explode(found).alias("f")).select(*keys, "f.*").distinct()
    before = Window.partitionBy(*keys, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("hit")).over(before), F.lit(0)) + F.col("gap")
    value = F.when(F.col("kind") == "assign", F.regexp_extract("hit", PATTERNS["assign"], 2)).otherwise(F.col("hit"))
    placed = rows.withColumn("start", start).withColumn("end", start + F.length("hit")).withColumn("value", value)
    runs = F.regexp_count("value", F.lit("[0-9]+")) + F.regexp_count("value", F.lit("[A-Za-z]+"))
    token = F.length("value").between(TOKEN_LENGTH, TOKEN_MOST) & (runs >= TOKEN_RUNS)
    placed = placed.where(F.when(F.col("kind") == "assign", F.length("value") >= ASSIGN_LENGTH).when(F.col("kind") == "token", token).otherwise(True))
    placed = placed.withColumn("bits", F.when(F.length("value") <= TOKEN_MOST, secret_bits(F.col("value"))).otherwise(F.lit(float(TOKEN_MOST))))
    return placed.where((F.col("kind") != "token") | (F.col("bits") >= TOKEN_BITS)).select(*keys, "kind", "start", "end", F.sha2("value", 256).alias("value"), "bits")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos) of every value; an owner that is not known is one owner."""
    by_repo = found.groupBy("value", "owner", F.coalesce("repo", F.col("h").cast("string")).alias("repo")).agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, most_owners: int = MOST_OWNERS,
) -> DataFrame:
    """(id, h, spans) of every document that has a span; spans is an array of (start, k, end, kind, verdict, n_owners, n_repos) in order.

    k is the place of the kind in KINDS; verdict is `example` for a value of
    more than `most_owners` owners, `weak` for one of few bits, else `live`.  Tokens
    are spans where they look live and overlap no span of another kind.  Null
    and empty texts have no span; texts of any length are read whole; null owners
    are one owner; without `repo_col` a text is a repository, so exact copies
    count once per owner; rows repeated in full share one result row, other rows
    of one id, or of none, are told apart by their texts; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    found = candidates(docs, id_col, text_col, owner_col, repo_col).checkpoint()
    n = found.count()
    owned = saved(ownership(found), n)
    verdict = F.when(F.col("n_owners") > most_owners, EXAMPLE).when(F.col("bits") < LIVE_BITS, WEAK).otherwise(LIVE)
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    spans = found.join(small_side(owned, n, 100), "value").withColumn("verdict", verdict).where((F.col("kind") != "token") | (F.col("verdict") == LIVE))
    span = F.struct(F.col("start").cast("long").alias("start"), place.alias("k"), F.col("end").cast("long").alias("end"), "kind", "verdict", "n_owners", "n_repos")
    rows = spans.groupBy("id", "h").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    # the spans of one kind overlap none of their own, so a token meets a span of another where that ends after its start and begins before its end
    base = F.filter("spans", lambda s: s["kind"] != "token")
    clear = lambda s: (s["kind"] != "token") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.withColumn("base", base).select("id", "h", F.filter("spans", clear).alias("spans")).where(F.size("spans") > 0)


def op11_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest, spans and verdicts of every document."""
    docs = read_table(spark, sf_dir, "documents")
    found = find_secrets(docs).withColumnsRenamed({"id": "s_id", "h": "s_h"})
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = keys.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    where = lambda test: F.filter("spans", test)
    listed = lambda array: F.coalesce(F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))
    of = lambda kind: lambda s: s["kind"] == kind
    count = lambda test: F.coalesce(F.size(where(test)), F.lit(0)).cast("long")
    return rows.select(
        "doc_id", *[count(of(k)).alias(f"n_{k}") for k in KINDS], F.sha2(listed(where(lambda s: s["kind"] != "token")), 256).alias("base_sha256"), listed("spans").alias("spans"),
        count(lambda s: s["verdict"] == LIVE).alias("n_live"), count(lambda s: s["verdict"] == EXAMPLE).alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )


_SQL_KINDS = "\n  UNION ALL ".join(
    f"SELECT *, '{k}' AS kind, {i} AS k, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d"
    for i, (k, p) in enumerate(
        # SQL's engine knows neither look-behinds nor possessive quantifiers: without them the same runs are found, only slower
        {k: p.replace("'", "''").replace("(?<![0-9a-f])", "").replace(f"(?<!{_TOKEN})", "").replace("}+", "}") for k, p in PATTERNS.items()}.items()
    )
)
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({_SQL_KINDS}),
u AS (
  SELECT rid, doc_id, source, t, kind, k, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM m),
p AS (
  SELECT *, CASE kind WHEN 'assign' THEN regexp_extract(hit, '{PATTERNS["assign"].replace("'", "''")}', 2) ELSE hit END AS v,
    coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS s
  FROM u),
b AS (
  SELECT *, s + length(hit) AS e, CASE WHEN length(v) <= {TOKEN_MOST} THEN length(v) * list_entropy(string_split(v, '')) ELSE {TOKEN_MOST} END AS bits FROM p
  WHERE CASE kind WHEN 'assign' THEN length(v) >= {ASSIGN_LENGTH}
    WHEN 'token' THEN length(v) BETWEEN {TOKEN_LENGTH} AND {TOKEN_MOST} AND len(regexp_extract_all(v, '[0-9]+')) + len(regexp_extract_all(v, '[A-Za-z]+')) >= {TOKEN_RUNS} ELSE true END),
c AS (SELECT * FROM b WHERE kind <> 'token' OR bits >= {TOKEN_BITS}),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM c GROUP BY v),
j AS (
  SELECT c.*, n_owners, CASE WHEN n_owners > {MOST_OWNERS} THEN 'example' WHEN bits < {LIVE_BITS} THEN 'weak' ELSE 'live' END AS verdict
  FROM c JOIN o USING (v)),
f AS (
  SELECT * FROM j WHERE kind <> 'token' OR (verdict = 'live' AND NOT EXISTS (
    SELECT 1 FROM j x WHERE x.rid = j.rid AND x.kind <> 'token' AND x.s < j.e AND j.s < x.e))),
g AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (kind <> 'token') AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example, max(n_owners) AS most_owners
  FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners
FROM d LEFT JOIN g USING (rid)
"""
