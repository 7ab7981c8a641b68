import random
import re
from collections import defaultdict

import pytest

from veldt.llm.quotations import link_quotations

ROWS = [
    (1, 0, "user", "Hello there\nhow are you today my friend?\n\nSecond paragraph here"), (1, 1, "assistant", "Ann wrote:\n> Hello there\n> how are   you today my\n> friend?\n\nI am fine"),
    (1, 3, "user", "> > Hello there how are you today my friend?\n> I am fine\ngood"), (1, 4, "user", ">Second paragraph here\nok then"),
    (2, 0, "user", "unique line of text number two"), (2, 1, "a", None), (3, 0, "user", "> unique line of text number two\nfrom elsewhere"),
    (None, 0, "x", "> a"), (4, None, "x", "t"), (5, 7, "user", "> nothing\n>>> deep\n>> mid"), (6, 0, "u", "same"), (6, 1, "u", "same"), (6, 2, "u", "> same\nlast of equals"), (6, 2, "u", "> same\nlast of equals"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn int, role string, text string, thread string")
    got = {(r["conv_id"], r["turn"]): r for r in link_quotations(df).collect()}
    assert link_quotations(df).count() == len(ROWS)
    replies = {k: r["reply_to"] for k, r in got.items()}
    assert replies == {(1, 0): None, (1, 1): 0, (1, 3): 1, (1, 4): 0, (2, 0): None, (2, 1): 0, (3, 0): None, (None, 0): None, (4, None): None, (5, 7): None, (6, 0): None, (6, 1): 0, (6, 2): 1}
    assert [got[1, t]["text"] for t in (0, 1, 3, 4)] == [ROWS[0][3], "I am fine", "good", "ok then"]
    assert [got[1, t]["depth"] for t in (0, 1, 3, 4)] == [0, 1, 2, 1]
    assert (got[3, 0]["quoted_conv"], got[3, 0]["quoted_turn"]) == (2, 0)
    assert got[5, 7]["n_passages"] == 3 and got[5, 7]["text"] == "" and got[2, 1]["text"] == ""


def test_long_conversation(spark):
    """One conversation with most rows: chains far longer than the number of rounds."""
    df = spark.range(700).selectExpr("9L AS conv_id", "cast(id AS int) AS turn", "'user' AS role", "concat('message ', id) AS text")
    rows = link_quotations(df).collect()
    assert {(r["turn"], r["reply_to"], r["thread"], r["depth"]) for r in rows} == {(i, i - 1 if i else None, 0, i) for i in range(700)}


def test_given_conversations(spark):
    """Without quotations every turn answers the one before and texts stay as they are."""
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    source = {(r["conv_id"], r["turn"]): r["text"] for r in df.collect()}
    for r in link_quotations(df).collect():
        turns = sorted(t for c, t in source if c == r["conv_id"])
        at = turns.index(r["turn"])
        assert r["reply_to"] == (turns[at - 1] if at else None) and r["depth"] == at and r["text"] == source[r["conv_id"], r["turn"]]


def test_originals_that_exist_more_than_once(spark):
    """A passage of other conversations is linked to the smallest one outside its own, however many have it."""
    rows = [(c, 0, "u", "a text that many have") for c in (4, 5, 6, 7)] + [(9, 0, "u", "> a text that many have\nnew"), (4, 1, "u", "two"), (3, 0, "u", "> two\nthree"), (3, 1, "u", "two"), (2, 0, "u", "> lost\nx")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["quoted_conv"], r["quoted_turn"]) for r in link_quotations(df).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v[0] is not None} == {(9, 0): (4, 0), (3, 0): (4, 1)}


# --- brute force: a reader of lines, without regular expressions over whole texts or hashes -------------


def level_of(line):
    """How many marks begin a line, and what follows them."""
    level, at = 0, 0
    while True:
        step = 1 if line[at : at + 1] in (" ", "\t") and line[at + 1 : at + 2] == ">" else 0
        if line[at + step : at + step + 1] != ">":
            break
        level, at = level + 1, at + step + 1
    return level, line[at + 1 :] if level and line[at : at + 1] in (" ", "\t") else line[at:]


def split_message(text):
    """(own text, [(level, body) of each quoted passage])."""
    lines = (text or "").split("\n")
    levels = [level_of(x) for x in lines]
    if not any(n for n, _ in levels):
        return text or "", []
    passages, own = [], []
    for i, (level, body) in enumerate(levels):
        if level:
            if i and levels[i - 1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        elif not (re.search(r"\bwrote\s?:[ \t]*$", lines[i]) and ">" not in lines[i] and i + 1 < len(lines) and levels[i + 1][0]):
            own.append(lines[i])
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(n, "\n".join(b)) for n, b in passages]


def parts_of(body):
    pieces = [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]
    return {" ".join(p.split()).lower() for p in pieces} - {""}


def brute_links(rows):
    """{(conv, turn): (text, reply_to, n_passages, n_linked, quoted)} by comparing every passage with every message."""
    read = {(c, t): split_message(x) for c, t, x in rows}
    have = {k: parts_of(own) for k, (own, _) in read.items()}
    turns = defaultdict(list)
    for c, t in sorted(read):
        turns[c].append(t)
    out = {}
    for (c, t), (own, passages) in read.items():
        before = [x for x in turns[c] if x < t]
        linked, n_linked, outside = [], 0, []
        for level, body in passages:
            wanted = parts_of(body)
            inner = [(len(p.split()), x) for p in wanted for x in before if p in have[c, x]]
            if inner:
                n_linked += 1
                linked += [max(inner)] if level == 1 else []
            else:
                for p in wanted:
                    found = [k for k in have if k[0] != c and p in have[k]]
                    outside += [(len(p.split()), min(found))] if found else []
        reply = max(linked)[1] if linked else before[-1] if before else None
        out[c, t] = own, reply, len(passages), n_linked, max(outside)[1] if outside else None
    return out


def written(seed, conversations=30, turns=14, step=1):
    """Conversations whose messages quote earlier ones, whole or in part, nested, with introductions, stray quotes and shared lines."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(("alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta")) for _ in range(rng.randrange(1, 7)))
    rows = []
    for c in range(conversations):
        said = []
        for i in range(rng.randrange(1, turns)):
            body = [line() for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.3:
                body.insert(1, "")
            quoted = []
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                pool = said if said and rng.random() < 0.8 else [r[2] for r in rows] or said
                if pool:
                    lines = rng.choice(pool).split("\n")
                    cut = lines[rng.randrange(len(lines)) :] if rng.random() < 0.4 else lines
                    mark = rng.choice(("> ", ">", " > "))
                    quoted += (["Ann wrote:"] if rng.random() < 0.5 else []) + [mark + x for x in cut] + ([""] if rng.random() < 0.5 else [])
            text = "\n".join(quoted + body if rng.random() < 0.7 else body + quoted)
            said.append(text)
            rows.append((c, i * step, text))
    return rows


@pytest.mark.parametrize("seed,step", [(1, 1), (2, 1), (3, 3), (4, 7)])
def test_against_brute_force(spark, seed, step):
    """Deeply nested quotations, without and with gaps between turns: every link, and every text, as a reader finds them."""
    rows = written(seed, step=step)
    df = spark.createDataFrame([(c, t, "u", x, "clash", "clash") for c, t, x in rows], "conv_id long, turn int, role string, text string, hash string, at string")
    got = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["n_passages"], r["n_linked"], None if r["quoted_conv"] is None else (r["quoted_conv"], r["quoted_turn"])) for r in link_quotations(df).collect()}
    want = brute_links(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(rows)
    assert max(level_of(x)[0] for _, _, t in rows for x in t.split("\n")) >= 3 and sum(v[3] for v in want.values()) > 40 and any(v[4] for v in want.values())


def test_one_line_quoted_everywhere(spark):
    """A conversation where half of the turns say one line and the others quote it: each links to the turn before, in linear work."""
    n = 20_000
    df = spark.range(n).selectExpr("9L AS conv_id", "cast(id AS int) AS turn", "'u' AS role", "if(id % 2 = 0, 'ok', concat('> ok\nanswer ', id)) AS text")
    rows = link_quotations(df).collect()
    assert len(rows) == n and all(r["reply_to"] == (r["turn"] - 1 if r["turn"] else None) and r["n_linked"] == r["turn"] % 2 for r in rows)


def test_odd_conversations(spark):
    """Null and empty texts, very long ones, repeated turns, null keys and clashing names."""
    long = "> a line\n" * 20_000 + "own"
    rows = [(1, 0, None), (1, 1, ""), (1, 1, ""), (1, 2, long), (1, 3, "> own"), (None, 5, "> own"), (1, None, "x"), (2, -4, "a line"), (2, 9, "\n\n\n\nkept as it is  ")]
    df = spark.createDataFrame([(c, t, "u", x, "y", "y") for c, t, x in rows], "conv_id long, turn int, role string, text string, up string, previous string")
    got = {(r["conv_id"], r["turn"]): r for r in link_quotations(df).collect()}
    assert link_quotations(df).count() == len(rows)
    assert got[1, 2]["text"] == "own" and got[1, 3]["reply_to"] == 2 and got[1, 2]["quoted_conv"] == 2 and got[1, 2]["quoted_turn"] == -4
    assert got[2, 9]["text"] == rows[-1][2] and got[2, 9]["reply_to"] == -4 and got[None, 5]["text"] == "" and got[1, 0]["text"] == ""
