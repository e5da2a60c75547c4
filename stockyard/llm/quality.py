"""Quality rules: per-document counts, and the frequency of normalised lines among a host's documents.

A line (words lower-cased in A-Z, digits made 0, single spaces) that more than `limit` documents of a host have is boilerplate, whatever
the size of the host: it goes from all but one of them (the one with the least doc_id, so the corpus keeps one copy of what it says). A document left with less than `depleted`
of its words is rejected, as is one that fails the base rules.

Nulls: a null text has no word (and so fails the base rules), a null host is a host of its own. Repeated rows are documents of their
own. An empty table gives an empty result. Only the named columns are read and kept, others pass through clean() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm import bytetext as B
from stockyard.llm import common as C

LIMIT, DEPLETED = 20, 0.2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = B.LOWER.copy()
_NORMAL[48:58] = 48


def _group_first(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, in order: whether its (row, key) was there before, and how often (row, key) is there."""
    if not len(rows):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    by = np.lexsort((keys, rows))
    r, k = rows[by], keys[by]
    new = np.ones(len(by), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(by)))
    again, count = np.empty(len(by), bool), np.empty(len(by), np.int64)
    again[by] = ~new
    count[by] = np.repeat(n, n)
    return again, count


def measures(column: pa.Array) -> Iterator[tuple[int, int, dict]]:
    """For runs of rows: first, last + 1, and the measures of each row's whole text as arrays; lines as (bounds, hash, words)."""
    for lo, hi, data, at in B.slices(column):
        n = hi - lo
        s, e, bounds = B.words(data, at)
        before = B.points_before(data)
        row = B.owners(bounds)
        raw = B.segments(data, s, e)
        tri = raw[:-2] + raw[1:-1] * np.uint64(0x9E3779B97F4A7C15) + raw[2:] * np.uint64(0xD6E8FEB86659FD93) if len(raw) > 2 else np.zeros(0, np.uint64)
        whole = row[:-2] == row[2:] if len(raw) > 2 else np.zeros(0, bool)
        starts = np.flatnonzero(whole)
        _, times = _group_first(row[starts], B.mix(tri[starts]))
        inside = np.zeros(len(row) + 3, np.int64)
        np.add.at(inside, hits := starts[times > 1], 1)
        np.add.at(inside, hits + 3, -1)
        repeated = np.cumsum(inside)[: len(row)] > 0
        # Lines end at \n or with the text.
        cut = np.union1d(np.flatnonzero(data == 10), at[1:] - 1) if len(data) else np.zeros(0, np.int64)
        cut = cut[cut >= 0]
        line_s = np.union1d(at[:-1][at[:-1] < len(data)], (nl := np.flatnonzero(data == 10) + 1)[nl < len(data)])
        line_e = np.minimum(np.append(line_s[1:], len(data)), len(data))
        line_e = line_e - ((line_e > line_s) & (data[np.maximum(line_e, 1) - 1] == 10) if len(line_s) else 0)
        first, last = np.searchsorted(s, line_s), np.searchsorted(s, line_e)
        lrow = np.searchsorted(at, line_s, "right") - 1
        index = np.arange(len(line_s)) - np.searchsorted(lrow, lrow)
        full = last > first
        line_s, line_e, first, last, lrow, index = (x[full] for x in (line_s, line_e, first, last, lrow, index))
        again, _ = _group_first(lrow, B.segments(data, line_s, line_e))
        normal = B.segments(B.segments(_NORMAL[data], s, e), first, last, B.WORD_BASE)
        add = lambda rows, x=None: np.bincount(rows, x, n).astype(np.int64)
        yield lo, hi, {
            "n_words": np.diff(bounds),
            "word_chars": add(row, before[e] - before[s]),
            "n_symbols": np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[at]) if len(data) else np.zeros(n, np.int64),
            "n_dup_lines": add(lrow[again]),
            "n_repeat_words": add(row[repeated]),
            "lines": (np.searchsorted(lrow, np.arange(n + 1)), normal.view(np.int64), last - first, index),
        }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("_text")
        rest = [n for n in b.schema.names if n != "_text"]
        for lo, hi, m in measures(text):
            bounds, normal, words, index = m["lines"]
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))  # noqa: E731, B023
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *[pa.array(m[c], pa.int64()) for c in _COUNTS], lists(normal, pa.int64()), lists(words, pa.int32()), lists(index, pa.int32())], [*rest, *_COUNTS, "_lines", "_line_words", "_line_index"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep_text: bool = False) -> DataFrame:
    """_id, _host (, _text again as _kept), the counts, and the lines with a word as three arrays: hash, words, index among all lines."""
    of = lambda c: F.col(f"`{c}`")
    df = docs.select(of(id_col).alias("_id"), of(host_col).cast("string").alias("_host"), of(text_col).cast("string").alias("_text"), *([F.struct(*map(of, docs.columns)).alias("_kept")] if keep_text else []))
    C.bounded_batches(docs.sparkSession)
    counts = [T.StructField(c, T.LongType()) for c in _COUNTS]
    lists = [T.StructField(c, T.ArrayType(k)) for c, k in (("_lines", T.LongType()), ("_line_words", T.IntegerType()), ("_line_index", T.IntegerType()))]
    return df.mapInArrow(_measured, T.StructType([*df.drop("_text").schema.fields, *counts, *lists]))


def frequent_lines(rows: DataFrame, limit: int) -> DataFrame:
    """(_host, _line, _owner) of the lines above the limit. One row a line and host, summed before the shuffle; _owner: the least (id, row)."""
    each = rows.select("_host", F.struct("_id", "_row").alias("_who"), F.explode(F.array_distinct("_lines")).alias("_line"))
    counts = each.groupBy("_host", "_line").agg(F.count("*").alias("_n"), F.min("_who").alias("_owner")).filter(F.col("_n") > limit)
    return counts.select("_host", "_line", F.col("_owner._row").alias("_owner"))


def judged(docs: DataFrame, limit: int = LIMIT, depleted: float = DEPLETED, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep_text: bool = False) -> DataFrame:
    """A row for each row of docs: _id, the counts, n_removed_words, base_failed, kept, and _gone (indexes of lines to take out)."""
    rows, path = C.written(measure(docs, id_col, text_col, host_col, keep_text).withColumn("_row", F.monotonically_increasing_id()), "quality")
    often, _ = C.written(frequent_lines(rows, limit), "frequent-lines")
    lines = rows.select("_row", "_host", F.explode(F.arrays_zip("_lines", "_line_words", "_line_index")).alias("_l")).select("_row", "_host", F.col("_l._lines").alias("_line"), F.col("_l._line_words").alias("_w"), F.col("_l._line_index").alias("_i"))
    often = C.small_or_not(often)
    hits = lines.join(often, (lines["_line"] == often["_line"]) & lines["_host"].eqNullSafe(often["_host"]) & (lines["_row"] != often["_owner"]))
    gone = hits.groupBy("_row").agg(F.sum("_w").alias("_gone_words"), F.collect_set("_i").alias("_gone"))
    out = rows.drop("_lines", "_line_words", "_line_index").join(gone, "_row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("_gone_words", F.lit(0)).cast("bigint")
    return out.withColumns({"n_removed_words": removed, "base_failed": failed, "kept": ~failed & (F.col("n_words") - removed >= depleted * F.col("n_words"))})


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, with boilerplate lines taken out of text (and n_chars, if there is one, set anew); all columns of docs."""
    text = limits.get("text_col", "text")
    df = judged(docs, keep_text=True, **limits).filter("kept")
    whole = F.col(f"_kept.`{text}`")
    left = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(F.filter(F.split(whole, "\n", -1), lambda _, i: ~F.array_contains("_gone", i)), "\n"))
    out = df.select(*[left.alias(c) if c == text else F.col(f"_kept.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs).select(F.col("_id").alias("doc_id"), *_COUNTS, "n_removed_words", "base_failed", "kept")


QUERIES = {"op7_quality": op7_quality}
# The digit and letter rules of a normalised line, its words joined by one space, in SQL.
_NORM = r"regexp_replace(trim(regexp_replace(translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[ \t\n\v\f\r]+', ' ', 'g')), '^ | $', '', 'g')"
ORACLE_SQL = {
    "op7_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, source, ln, i, len(regexp_extract_all(ln, '[^ \t\n\v\f\r]+')) AS nw, {_NORM} AS norm FROM ln WHERE regexp_matches(ln, '[^ \t\n\v\f\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n FROM l GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p+1], w[p+2]) AS n FROM t),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p+1, p+2]) AS q FROM tri WHERE n > 1) GROUP BY doc_id),
often AS (SELECT l.source, norm, min(doc_id) AS owner FROM l GROUP BY l.source, norm HAVING count(DISTINCT doc_id) > {LIMIT}),
gone AS (SELECT doc_id, sum(nw) AS n FROM l JOIN often o ON l.source = o.source AND l.norm = o.norm AND l.doc_id <> o.owner GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= CAST({DEPLETED} AS DOUBLE) * n_words AS kept FROM f
""",
}
