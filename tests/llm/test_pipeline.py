"""The pipeline, stage by stage, against brute force on what its predecessor kept."""

import re

import corpus_pipeline as C
from test_exact_dedup import brute as copies
from test_ngram_join import brute as near

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()} if name != "mix_sources" and name != "best_fit_packing" else docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    rules, exact, joined, mixed, packed = seen
    source = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(source[i] == r for i, r in rules.items()) and 0 < len(rules) < len(source)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    long_good = [i for i, q in labels.items() if q == 1 and len(WORD.findall(source[i]["text"])) >= 80]
    assert sum(i in rules for i in long_good) >= 0.97 * len(long_good)
    assert set(exact) == {keep for _, keep, _ in copies([(i, r["text"]) for i, r in rules.items()])}
    assert set(joined) == {c for _, c in near([(i, r["text"]) for i, r in exact.items()]).values()}
    words = {i: len(WORD.findall(r["text"])) for i, r in joined.items()}
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert set(taken) <= set(joined) and all(n <= 2 * words[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.02 * sum(words.values())
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= -(-total // 1024) + 2


def test_run_and_empty_table(spark, empty):
    assert C.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert C.run(spark, empty).count() == 0


COPY = "the same text of more words than five"


def test_copies_go_and_nothing_else(spark):
    """Rows are told apart by id and text, not by id alone."""
    rows = [(3, COPY), (7, COPY), (7, "other text"), (None, "lost text"), (None, COPY), (9, None), (9, ""), (8, "  "), (3, COPY), (None, "lost  text")]
    df = spark.createDataFrame([(*r, "en", "a", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    for stage in (C.exact_copies, C.near_copies):
        out = stage(spark, df, SF)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert out.columns == df.columns
        if stage is C.exact_copies:
            # equal after white space is collapsed; null is empty; of one id's rows one stays
            assert [g for g in got if g[1] not in ("lost text", "lost  text", None, "", "  ")] == [(3, COPY), (7, "other text")]
            assert len([g for g in got if g[0] is None]) == 1 and [g[0] for g in got if g[1] in (None, "", "  ")] in ([8, 9], [9, 8])
        else:
            # texts without words are linked with nothing
            assert len([g for g in got if g[1] in (None, "", "  ")]) == 3 and [g for g in got if g[1] == COPY] == [(3, COPY)]
            assert (7, "other text") in got and len([g for g in got if g[0] is None]) == 1


def test_mix_finds_rows_again(spark):
    """Rows without an id, or that repeat id and text, are documents of the mix like others."""
    rows = [(None, "one two three", "a"), (None, "four five", "a"), (1, "six seven", None), (1, "eight", "b"), (1, "eight", "b"), (2, None, "b")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.source_mix(spark, df, SF).collect()
    given = {(i, t) for i, t, _ in rows}
    assert out and {(r["doc_id"], r["text"]) for r in out} <= given and all(r["n_chars"] == len(r["text"]) for r in out)
    assert sum(r["doc_id"] is None for r in out) >= 2 and sum((r["doc_id"], r["source"]) == (1, None) for r in out) >= 1


def test_odd_table(spark, stored_ids, odd_ids):
    """All stages on nulls, ties, repeats, very long texts and clashing names: what stays is what brute force keeps."""
    docs = odd_ids
    rules = C.quality_rules(spark, docs, SF).cache()
    kept = {(r["doc_id"], r["text"]) for r in rules.collect()}
    counts = {(r["doc_id"], r["text"]): len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert kept <= {k for k, n in counts.items() if n >= 50} and any(n > 10_000 for k, n in counts.items() if k in kept)
    exact = C.exact_copies(spark, docs, SF)
    groups = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), []).append(r["doc_id"])
    want = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    got = [(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"]) for r in exact.collect()]
    assert sorted(got, key=str) == sorted(want.items(), key=str) and exact.columns == docs.columns
    packed = C.run(spark, stored_ids).collect()
    assert {r["doc_id"] for r in packed} <= {i for i, _ in kept} and packed
