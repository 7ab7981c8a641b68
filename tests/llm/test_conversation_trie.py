"""The trie over rebuilt conversations against one built of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veldt.llm import conversation_trie as trie


def plain_version(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    whole = {}
    for c, own in turns.items():
        own.sort()
        h = zlib.crc32(str(c).encode()) % 6
        head = sorted(turns.get(int(c - (c % 100 if c >= 0 else -(-c % 100))), []))[:h]
        whole[c] = tuple((r, t) for _, _, r, t in head + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(df, **how).collect()), key=str)
    assert got == sorted(plain_version(rows), key=str)


def many(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é日", ""]) * rng.randint(0, 2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, fan", [(trie.BLOCK, trie.FAN), (3, 2)])
def test_against_plain_version(spark, block, fan):
    odd = [(7, None, None, None), (7, None, "user", "first"), (7, 0, "user", None), (7, 0, "user", None), (7, 0, "a", "tie"), (7, 0, "b", "tie"), (None, 1, "user", "nobody's"), (2**62 + 7, 3, "user", "far"), (-250, 0, "user", "below"), (-201, 0, "x", "y" * 70_000)]
    check(spark, many(1, [*range(40), *range(95, 130), *range(300, 305)], 9) + odd, block=block, fan=fan)


def test_one_long_conversation_and_many_equal_ones(spark):
    """A third of all turns in one conversation, another third in copies of one, over blocks and tasks."""
    rows = [(5, i, "user", f"t{i % 7}") for i in range(400)] + [(c, i, "user", f"t{i}") for c in range(1000, 1100) for i in range(4)] + many(2, range(200, 300), 5)
    check(spark, rows, block=16)


def test_turnless_conversations(spark):
    short = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2][:4]
    check(spark, [(c, 0, "user", "x") for c in short] + [(501, 0, "user", "y")])


def test_deep_shared_path(spark):
    """Rollups over a path of 70 shared nodes with branches at many depths."""
    rows = [(c * 100, i, "user", f"t{i}" if i < 70 - c else f"other {c}") for c in range(12) for i in range(70)]
    check(spark, rows)


def test_ends_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    check(spark, [(c, 0, "user", "same") for c in range(100)])
