import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veldt.llm import packing as P

SPEC = P.default_tokenizer()
ODD = ["", " ", "  two  spaces ", "line\n\n\nbreaks\r\n\ttabs", "don't we'll I'm", "日本語 émigré ß", "a b   c　d", "1234567 89,000.5", "<|endoftext|> in <|endoftext|>", "x" * 5000, "!?#" * 400, " " * 3000, "\x00\x01\x0b\x0c", "é \U0001f600"]


def test_ids_equal_the_library(documents):
    plain, fast = Tokenizer.from_file(SPEC), P.load_encoder(open(SPEC, "rb").read())
    for t in ODD + [r["text"] for r in documents.select("text").limit(60).collect()]:
        assert fast(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:50]


def test_other_tokenizers_run_on_the_library():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, found = Tokenizer.from_file(path), P.load_encoder(open(path, "rb").read())
    for t in ODD[:9]:
        assert found(t).tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n,want", [(1, [1]), (1024, [1024]), (1025, [1, 1024]), (2048, [1024, 1024]), (3000, [952, 1024, 1024])])
def test_cuts(n, want):
    assert P.cut_lengths(n, 1024) == want


def check_grouping(lengths, grouping, capacity):
    assert (grouping >= 0).all() and np.bincount(grouping, weights=lengths).max() <= capacity


def test_crossover_keeps_all_pieces():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 101, 200))[::-1]
        a, b = P.best_fit(lengths, rng.permutation(200), 100), P.best_fit(lengths, np.arange(200), 100)
        child = P.crossover(lengths, a, b, 100, rng)
        check_grouping(lengths, child, 100)
        best = P.evolve(lengths, [a, b], 100, 10, rng)
        check_grouping(lengths, best[0], 100)
        assert len(set(best[0])) <= min(len(set(a)), len(set(b)))


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly: falling best fit wastes room, evolution wins some back."""
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(60):
        a, b = rng.integers(260, 500), rng.integers(260, 380)
        lengths += [a, b, 1000 - a - b]
    lengths = np.sort(np.array(lengths))[::-1]
    first = P.best_fit(lengths, np.arange(len(lengths)), 1000)
    population = [first] + [P.best_fit(lengths, np.argsort(-lengths * (1 + 0.15 * rng.random(len(lengths))), kind="stable"), 1000) for _ in range(5)]
    best = P.evolve(lengths, population, 1000, 150, rng)[0]
    check_grouping(lengths, best, 1000)
    assert len(set(best)) < len(set(first))


@pytest.mark.parametrize("per_shard", [P.PIECES_PER_SHARD, 50])
def test_whole_packing(spark, documents, odd, per_shard, monkeypatch):
    monkeypatch.setattr(P.pack_pieces, "__defaults__", (P.CAPACITY, per_shard, P.ISLANDS, P.EPOCHS))
    df = documents.select("doc_id", "text").unionByName(odd.where("doc_id <> 7").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = P.pack_documents(df, SPEC, with_ids=True).toPandas()
    texts = dict(df.toPandas().itertuples(index=False))
    plain = Tokenizer.from_file(SPEC)
    for doc, own in rows.groupby("doc_id"):
        own = own.sort_values("piece")
        ids = [i for part in own["ids"] for i in part]
        assert ids == [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert own["piece"].tolist() == list(range(len(own)))
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]] == own["ids_crc32"].tolist()
        assert len(own) == 1 or own["length"].tolist()[1:] == [1024] * (len(own) - 1)
    assert set(rows["doc_id"]) == set(texts)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 1024
    if per_shard > 1000:
        assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 1024) + 2
