import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from veldt.llm import sanitise as S

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


HARD = [
    "", None, "a@b.c_d@e.f x@y.z", "é 4111 1111 1111 1111 ü 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 001.02.0255.4 256.1.1.1 1.1.1.0256", "+1 (988) 555-2485 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "4111 1111 1111 1111 1", "5  4111111111111111", "a@b a@b. a@.c a%@b-.c-", "-4111111111111111-", "+4111111111111111@x.y", "@@a@b.c@d.e", "1" * 5000, "1 " * 5000, "a" * 5000, "a.b@" * 1000 + "c.d", "9" * 40 + "@x.y.z", "+1" + "(" * 3000,
]


def test_base_spans(spark, documents, tmp_path):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ab1234@.+- ()%5é4") for _ in range(60)) for _ in range(1000)] + [r["text"] for r in documents.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for r in S.op6_pii_sanitise(spark, str(tmp_path)).collect():
        want = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), texts[r["doc_id"]]
        assert r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in S.KINDS] == [sum(w[0] == k for w in want) for k in S.KINDS]


def secrets(t):
    """Long tokens of letters and digits by turns, that carry 64 bits."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9_]{20,}", t or "", re.A):
        bits = sum(-n * math.log2(n / len(m[0])) for n in Counter(m[0]).values())
        if len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", m[0])) >= 4 and bits >= 64:
            out.append(("secret", m.start(), m.end()))
    return out


def corpus():
    rng = random.Random(3)
    filler = ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(600)]
    text = lambda: " ".join(rng.choice(filler) for _ in range(12))
    rows = [f"write to Zorblax Quuxly, {text()} at zq{i % 2}@mail.org about {text()}" for i in range(8)]
    rows += [f"{text()} 10.0.0.{i} server Kelvex {text()}" for i in range(9)] + [f"pay Rumold by 4111 1111 1111 1111 {text()}" for _ in range(4)]
    rows += [f"call Vintor or Vinten on +1 (988) 555-2485 {text()}" for _ in range(4)] + [f"passkey {''.join(rng.choice('0123456789abcdef') for _ in range(40))} {text()}" for _ in range(7)]
    rows += [text() for _ in range(80)] + [f"Vinten {text()}", f"Zornal {text()}", "Quuxly alone without an address"]
    rows += [rows[0]] * 2 + ["seen once: Vexmor vx@mail.org", None, ""]
    return rows


def brute_terms(rows, generalise=S.GENERALISE, remove=S.REMOVE):
    """{(row, term): (action, put)} by loops over all documents, entities and terms."""
    import xxhash

    words = [set(re.findall(r"[^\W\d_](?:[^\W_]){2,}", (t or "").lower())) for t in rows]
    terms = [w | {x[:k] + "*" for x in w for k in S.LEVELS if len(x) > k} for w in words]
    sketch = [min((xxhash.xxh64(w.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63 for w in ws) if ws else 0 for ws in words]
    held = defaultdict(set)
    for i, t in enumerate(rows):
        for k, a, b in brute(t) + secrets(t):
            v = t[a:b] if k == "secret" else re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower()
            held[k, v].add(i)
            held[k, None].add(i)
    n, df_t, shares = len(rows), Counter(x for ts in terms for x in ts), {}
    for e, docs in held.items():
        for x in set().union(*(terms[i] for i in docs)):
            both = [i for i in docs if x in terms[i]]
            same = Counter(sketch[i] for i in both)
            worth = sum(same.values()) ** 2 / sum(c * c for c in same.values())
            share = math.log2(n * len(both) / (df_t[x] * len(docs))) / math.log2(n / len(docs))
            if worth >= (S.EVIDENCE if e[1] is not None else S.KIND_EVIDENCE) and share >= generalise:
                for i in both:
                    shares[i, x] = max(shares.get((i, x), 0), share)
    out = {}
    for (i, x), share in shares.items():
        if not x.endswith("*"):
            levels = [x[:k] + "*" for k in S.LEVELS if len(x) > k and (i, x[:k] + "*") not in shares]
            out[i, x] = ("removed", "") if share >= remove else ("generalised", levels[0] if levels else "[TERM]")
    return out


def test_disclosing_terms(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_terms(rows)
    for broadcast in (S.BROADCAST_ROWS, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
        terms = S.disclosing_terms(df, S.spans_of(df).checkpoint()).collect()
        assert {(r["id"], r["term"]): (r["action"], r["put"]) for r in terms} == want
    named = {w for _, w in want}
    # a name beside an address, a word beside any address of a kind, beside a card, a number and a key; never a text seen once
    assert {"zorblax", "kelvex", "rumold", "vintor", "passkey"} <= named and "vexmor" not in named
    assert {a for a, _ in want.values()} == {"removed", "generalised"} and any(p.endswith("*") for _, p in want.values())
    found = S.sanitise(df).collect()
    for r in found:
        t = rows[r["id"]]
        fixed = [(b["start"], b["end"]) for b in [*r["base"], *r["secrets"]]]
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_](?:[^\W_]){2,}", t) if (r["id"], m[0].lower()) in want]
        assert [(x["start"], x["end"]) for x in r["terms"]] == [p for p in places if not any(a < p[1] and p[0] < b for a, b in fixed)]
    # documents without an entity are left alone, and redaction keeps the rest of the text
    assert {r["id"] for r in found} == {i for i, t in enumerate(rows) if brute(t) + secrets(t)}
    out = {r["doc_id"]: r["text"] for r in S.redacted(df).collect()}
    assert all(out[i] == t for i, t in enumerate(rows) if not brute(t) + secrets(t)) and "Zorblax" not in out[0] and "[EMAIL]" in out[0]
    assert all("[SECRET]" in out[i] for i, t in enumerate(rows) if t and t.startswith("passkey"))


def test_near_copies_are_no_evidence(spark):
    """Many copies of one text, each with another word, disclose nothing; as many different texts do."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    base = [word() for _ in range(60)]
    copies = [" ".join([*base, word(), "secretary", f"to a{i}@one.org"]) for i in range(40)]
    others = [" ".join([*(word() for _ in range(60)), "hidden", f"at 10.1.1.{i}"]) for i in range(40)]
    rows = copies + others + [" ".join(word() for _ in range(60)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = {r["term"] for r in S.disclosing_terms(df, S.spans_of(df).checkpoint()).collect()}
    assert "hidden" in terms and not terms & {*base, "secretary"}


def test_secrets(spark):
    rng = random.Random(9)
    texts = ["x" * 40, "a1" * 30, "word_with_many_parts_of_2020", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "é9b0b3c6a43eb78aa99cbd7049c572391524f37a8é", "1" * 3000, "aB3" * 2000]
    texts += ["".join(rng.choice("abcDEF0123_ .") for _ in range(300)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["id"], r["start"], r["end"]) for r in S.spans_of(df).where("kind = 'secret'").collect())
    assert got == sorted((i, a, b) for i, t in enumerate(texts) for _, a, b in secrets(t)) and got


def test_no_python_in_the_plan(spark, documents):
    S.prepare(spark)
    plan = S.spans_of(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
