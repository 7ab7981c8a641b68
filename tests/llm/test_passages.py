"""Repeated passages against all pairs of paragraphs and against the words of all other documents."""

import random
import re
from collections import defaultdict

import pytest

from veldt.llm import paragraphs as G

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(text, min_words=G.MIN_WORDS):
    """(start, end, words) of each line of enough words."""
    low, at, out = (text or "").translate(LOW), 0, []
    for line in low.split("\n"):
        spans = [m.span() for m in WORD.finditer(line)]
        if len(spans) >= min_words:
            out.append((at + spans[0][0], at + spans[-1][1], [line[a:b] for a, b in spans]))
        at += len(line) + 1
    return out


def shingles(w):
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4))


def close(a, b):
    o = len(a & b)
    return 100 * o >= 75 * (len(a) + len(b) - o)


def paragraph_classes(docs):
    """(doc, start, end) of every paragraph in a class of two documents, with the class's first, by all pairs."""
    units = [((i, a, b), shingles(w)) for i, t in sorted(docs.items()) for a, b, w in lines(t)]
    group = list(range(len(units)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for x in range(len(units)):
        for y in range(x):
            if close(units[x][1], units[y][1]):
                a, b = find(x), find(y)
                group[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for x in range(len(units)):
        members[find(x)].append(units[x][0])
    return {u: own[0] for own in members.values() if len({i for i, _, _ in own}) > 1 for u in own}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def check_windows(rows, docs):
    """The words of every window stand in another document; of each class all but the first go."""
    flat = {i: " " + " ".join(WORD.findall((t or "").translate(LOW))) + " " for i, t in docs.items()}
    for r in rows:
        if r["kind"] == "window":
            words = WORD.findall(docs[r["id"]][r["start"] : r["start"] + r["length"]].translate(LOW))
            assert len(words) == G.WINDOW_WORDS
            assert any(f" {' '.join(words)} " in t for i, t in flat.items() if i != r["id"])
        assert r["removed"] == ((r["id"], r["unit"]) != (r["class_id"], r["class_unit"])) and r["class_size"] > 1


def sharing(docs, n=G.PASSAGE_WORDS):
    """Documents that share n words in a row, other than a run of one word, with another."""
    holders = defaultdict(set)
    for i, t in docs.items():
        w = WORD.findall((t or "").translate(LOW))
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if len(set(run)) > 10:
                holders[run].add(i)
    return {i for own in holders.values() if len(own) > 1 for i in own}


def sample(seed=7):
    """Paragraphs in families of near copies, passages inside lines and over lines, verse, lists, short lines, empty texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    families = [[word() for _ in range(rng.choice([22, 35, 60, 120, 300]))] for _ in range(8)]
    inside, over = [word() for _ in range(60)], "\n".join(sentence(12) for _ in range(5))
    licence = "Licensed under the open licence version two point nought"
    docs = {}
    for i in range(40):
        body = [sentence(rng.randrange(3, 60)) for _ in range(4)]
        for _ in range(2):
            w = list(rng.choice(families))
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            body.insert(rng.randrange(len(body)), " ".join(w) if rng.random() < 0.7 else " ".join(w).upper() + " ")
        if i % 4 == 0:
            host = sentence(40).split()
            body.append(" ".join([*host[: 3 + i], *inside, *host[3 + i :]]))
        if i % 5 == 0:
            body.insert(1, over)
        docs[i] = rng.choice(["\n", "\n\n", " \n\t\n"]).join([*body, licence])
    exact = sentence(20)
    docs |= {100: None, 101: "", 102: "\n\n", 103: docs[7], 104: docs[7], 105: exact, 106: f"{word()}\n{exact}\n{word()}", 107: "again " * 90, 108: " ".join(inside), 109: licence}
    return docs


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_all_pairs(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(G, "BROADCAST_NAMES", 0)
        monkeypatch.setattr(G, "REMEMBERED", 20)
    docs = sample()
    rows = G.repeated_passages(frame(spark, docs)).collect()
    got = {(r["id"], r["start"], r["start"] + r["length"]): (r["class_id"], r["class_unit"]) for r in rows if r["kind"] == "paragraph"}
    want = paragraph_classes(docs)
    assert got.keys() == want.keys()
    first = {(r["id"], r["unit"]): (r["id"], r["start"], r["start"] + r["length"]) for r in rows if r["kind"] == "paragraph"}
    assert {u: first[c] for u, c in got.items()} == want
    check_windows(rows, docs)
    assert sharing(docs) <= {r["id"] for r in rows}
    assert not {100, 101, 102, 109} & {r["id"] for r in rows}, "a line of nine words is no passage"


@pytest.mark.parametrize("words", [10, 20, 30, 45, 60, 100, 200])
def test_recall_of_edited_paragraphs(spark, words):
    """Of 80 pairs of paragraphs with a word in 60 changed, one at least, or a word more, those of a similarity of 0.75 are found."""
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs, pairs = {}, []
    for k in range(80):
        a = [word() for _ in range(words)]
        b = list(a)
        if words < 45 and k % 2:
            b.append(word())
        else:
            for p in rng.sample(range(words), max(1, words // 60)):
                b[p] = word()
        for i, w in ((2 * k, a), (2 * k + 1, b)):
            docs[i] = "\n".join([" ".join(word() for _ in range(30)), " ".join(w), " ".join(word() for _ in range(30))])
        if close(shingles(a), shingles(b)):
            pairs.append((2 * k, 2 * k + 1))
    found = {(r["id"], r["class_id"]) for r in G.repeated_passages(frame(spark, docs), min_words=min(words, G.MIN_WORDS)).collect()}
    assert len(pairs) >= 40
    assert sum((b, a) in found for a, b in pairs) >= 0.95 * len(pairs)


def test_every_passage_of_its_length_is_found(spark):
    """Passages of 51 words of any kind between words of their hosts: none is missed."""
    rng = random.Random(11)
    kinds = [lambda: rng.choice("abcdefgh"), lambda: f"w{rng.randrange(50)}", lambda: f"w{rng.randrange(9000)}" + rng.choice([".", "", "", "!"]), lambda: rng.choice(["to", "fro", "and"])]
    rows, n = {}, 0
    for kind in kinds * 8:
        passage = [kind() for _ in range(G.PASSAGE_WORDS)]
        for _ in range(2):
            host = [f"h{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))], [f"h{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]
            rows[n] = rng.choice([" ", "\n"]).join([*host[0], *passage, *host[1]])
            n += 1
    got = {r["id"] for r in G.repeated_passages(frame(spark, rows)).select("id").collect()}
    assert got == set(rows)


def test_copies_of_one_line_in_many_documents(spark):
    """A line of 20 words in 300 documents, among them rows without an id and repeated rows: all but one go."""
    line = " ".join(f"l{i}" for i in range(20))
    rows = [(i if i >= 20 else None, f"own {i} words\n{line}\nmore {i}") for i in range(300)] + [(50, "own 50 words\n" + line + "\nmore 50")] * 3
    out = G.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(out) == 303 and sum(not r["removed"] for r in out) == 1
    assert {r["class_id"] for r in out} == {20} and sum(r["id"] is None for r in out) == 20


def test_null_ids_alone(spark):
    line = " ".join(f"l{i}" for i in range(25))
    out = G.repeated_passages(spark.createDataFrame([(None, f"{line}\na"), (None, f"b\n{line}"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted(r["removed"] for r in out) == [False, True]
    with pytest.raises(ValueError):
        G.repeated_passages(spark.createDataFrame([(1, "a")], "doc_id long, text string"), min_words=3)


def test_given_documents(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = G.repeated_passages(documents).collect()
    assert sharing(docs) <= {r["id"] for r in rows}
    want, got = paragraph_classes(docs), {(r["id"], r["start"], r["start"] + r["length"]) for r in rows if r["kind"] == "paragraph"}
    # banding may miss a link of two contents in 200 at the threshold
    assert len(got ^ want.keys()) <= 0.005 * len(want)
    check_windows(rows, docs)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.75, 0.9):
        bands, rows = G.tune_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= G.RECALL
