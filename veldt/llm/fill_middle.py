"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in a new order.

A text is decoded to an array of code points.  Each code point belongs to a
class, here the number of its line; a unit ends where neighbouring classes
differ.  Two ranks of unit ends, drawn by a hash of the document's id, bound the
middle; the three slices of the array are encoded again and joined with marks.

A document's draw depends on its id and the seed alone, so a lost task gives the
same pieces again, and a task holds one batch of texts at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, read_table

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of the texts that are cut, and of these the ones whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 100, 50
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
PIECES = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4"))


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Place after each line: where neighbours belong to different lines, and the end of a text that is not empty."""
    if not len(points):
        return np.zeros(0, np.int64)
    line = np.cumsum(points == 10) - (points == 10)
    return np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, len(points))


def cut(text: str, draws: tuple[int, int, int, int], marks: tuple[str, str, str], cut_percent: int, suffix_first_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = code_points(text)
    ends = np.append(0, unit_ends(points))
    n = len(ends) - 1
    if not n or draws[2] % 100 >= cut_percent or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    a, b = sorted((int(ends[draws[0] % (n + 1)]), int(ends[draws[1] % (n + 1)])))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = marks
    if draws[3] % 100 < suffix_first_percent:
        return n, SUFFIX_FIRST, a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, PREFIX_FIRST, a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, marks: tuple[str, str, str] = MARKS,
    cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """The documents with a struct `out` of n (units), form, prefix_chars, middle_chars and output.

    A null text counts as empty; empty texts, texts that hold a mark, and those
    that are not to be cut stay as they are (form `plain`, no lengths).  A unit
    is a line with its end, or a last line without one.  A null id is drawn
    like an empty one; rows that repeat, or share an id, are each cut by the
    same draw; texts of any length are cut whole; other columns, whatever their
    names, stay; an empty table stays empty.  `out` replaces a column of its name.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf(PIECES)
    def pieces(text: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = [cut(t, h, marks, cut_percent, suffix_first_percent) for t, *h in zip(text, h1, h2, h3, h4)]
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return docs.withColumn(out, pieces(F.coalesce(F.col(text_col), F.lit("")), *draws))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; no mark can begin inside a piece, as cut texts hold none."""
    first = lambda text, mark: F.substring_index(text, mark, 1)
    rest = lambda text, mark: F.substr(text, F.length(first(text, mark)) + len(mark) + 1, F.length(text))
    p, s, m = marks
    after_p, after_s = rest(output, p), rest(output, s)
    psm = F.concat(first(after_p, s), rest(after_s, m), first(after_s, m))
    spm = F.concat(first(after_p, m), rest(after_p, m), first(after_s, p))
    return F.when(form == PREFIX_FIRST, psm).when(form == SUFFIX_FIRST, spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's pieces."""
    docs = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "fim")
    return docs.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (
  SELECT doc_id, t, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:], ''), '') AS suf
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
