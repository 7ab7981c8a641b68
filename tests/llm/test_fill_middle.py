"""Fill-in-the-middle against a plain version, and its round trip."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.llm.fill_middle import code_points, fill_in_middle, restored, unit_ends


def plain_version(doc_id, text, cut_percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a\né𝔘 \r "), max_size=40))
def test_units_are_lines(text):
    ends = unit_ends(code_points(text))
    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
    assert pieces == re.findall(r"[^\n]*\n|[^\n]+", text)
    assert isinstance(ends, np.ndarray)


@pytest.mark.parametrize("share", [100, 40, 0])
def test_against_plain_version(spark, odd_ids, share):
    more = [(i, t) for i, t in enumerate(["\n", "\n\n\n", "a<P>b\nc", "<S", "x<\nS>\ny<M", "𝔘𝔫𝔦\n𝔠\nödé", "no end\nof line", "\r\n a \r\n", "<", ">\n<\n>\n<P"] * 8)]
    docs = odd_ids.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = fill_in_middle(docs, "fim", cut_percent=share).select("doc_id", "text", "fim.*", restored(F.col("fim.output"), F.col("fim.form")).alias("back"), "bucket")
    rows = out.collect()
    assert len(rows) == docs.count() and {r["bucket"] for r in rows} == {"x", None}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"], share)
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in rows} == ({"plain"} if not share else {"plain", "psm", "spm"})


def test_other_marks(spark):
    docs = spark.createDataFrame([(i, f"eins <P>\nzwei {i}\ndrei") for i in range(50)], "doc_id long, text string")
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    rows = fill_in_middle(docs, "fim", marks=marks).select("text", "fim.form", restored(F.col("fim.output"), F.col("fim.form"), marks).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows) and {r["form"] for r in rows} == {"psm", "spm"}
