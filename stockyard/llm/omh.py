"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of five words (k-mers; a shorter text is one run). Each k-mer is labelled with its occurrence number.
A sketch keeps, for one hash function, the `kept` smallest labelled k-mers in the order in which they stand in the text, so texts meet in
it if they share those k-mers and their order: it follows edit similarity, not only sets. Texts of few k-mers have more, shorter sketches,
since few k-mers leave few ways to agree in eight.

Candidates meet in a bucket (one sketch's value). Each bucket compares its members with two of them (stars: a bucket of n has fewer than
2 n candidates, never n squared). What then still stands in a bucket with members of several components is compared without a cap: all pairs of those texts from different components whose
k-mers can overlap enough, found by length, prefix and position bounds that no pair at the similarity fails (see _possible). So no link
between texts that meet in a bucket is lost. A candidate is a link if the alignment of the two k-mer sequences (longest common
subsequence L) has L / (a + b - L) >= similarity. Classes are the connected components, found by alternating stars over written tables.

Equal texts are one node from the start. A null text counts as empty; empty texts (no word) are equal to each other only. Repeated rows and
equal or null ids are rows of their own; a class is called by its least id. Only id and text are read; other columns pass through.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stockyard.llm import bytetext as B
from stockyard.llm import common as C

WORDS, SIMILARITY = 5, 0.8
#: (hash functions, k-mers kept, only texts of up to so many k-mers). A pair at 0.8 meets in none of 64 by chance (1 - 0.8**8)**64 < 1e-5.
SKETCHES = ((64, 8, None), (16, 2, 64))
#: A k-mer of more texts is compared in so large blocks.
BLOCK = 1000
#: A text's parities: so many 64-bit numbers, in which each k-mer turns one bit.
LONGS = 16
_SET = np.uint64(0xA0761D6478BD642F)


def kmers(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all rows' k-mers, and the rows' bounds among them; a row of 1 to k - 1 words has one of all its words."""
    s, e, bounds = B.words(data, at)
    w = B.segments(data, s, e)
    n = np.diff(bounds)
    have = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out = np.concatenate([[0], np.cumsum(have)])
    first = np.repeat(bounds[:-1], have) + np.arange(out[-1]) - np.repeat(out[:-1], have)
    last = np.minimum(first + k, np.repeat(bounds[1:], have))
    return B.segments(w, first, last, B.WORD_BASE), out


def occurrence_labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones stand before it in the text)."""
    by = np.argsort(h, kind="stable")
    run = h[by]
    new = np.ones(len(h), bool)
    new[1:] = run[1:] != run[:-1]
    if new.all():
        return h
    first = np.flatnonzero(new)
    number = np.empty(len(h), np.uint64)
    number[by] = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)
    return np.where(number > 0, B.mix(h + number * _SET), h)


@functools.lru_cache
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, 1 << 63, n, np.uint64)[:, None], (g.integers(0, 1 << 63, n, np.uint64) | np.uint64(1))[:, None]


def order_sketches(h: np.ndarray, functions: int, kept: int, seed: int) -> np.ndarray:
    """One 64-bit value for each hash function: of the kept smallest labelled k-mers, in text order."""
    labelled = occurrence_labelled(h)
    n = len(labelled)
    xor, mul = _functions(functions, seed)
    out = np.empty(functions, np.uint64)
    step = max(1, (1 << 20) // n)
    for lo in range(0, functions, step):
        v = (labelled[None] ^ xor[lo : lo + step]) * mul[lo : lo + step]
        if n <= kept:
            where = np.broadcast_to(np.arange(n), v.shape)
        elif n <= 1 << 20:
            v = (v & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)[None]
            where = np.sort((np.partition(v, kept - 1, 1)[:, :kept] & np.uint64(0xFFFFF)).astype(np.int64), 1)
        else:
            where = np.sort(np.argpartition(v, kept - 1, 1)[:, :kept], 1)
        acc = np.full(len(v), seed, np.uint64) + np.arange(lo, lo + len(v), dtype=np.uint64) * _SET
        for j in range(where.shape[1]):
            acc = B.mix(acc * np.uint64(B.WORD_BASE) + labelled[where[:, j]])
        out[lo : lo + step] = acc
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    return np.concatenate([order_sketches(h, f, kept, 11 + i) for i, (f, kept, most) in enumerate(SKETCHES) if most is None or len(h) <= most]) if len(h) else np.zeros(0, np.uint64)


# Alignment


def common_subsequence(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence that stays within `band` of the diagonal: bits of one number are a's positions."""
    if not a or not b:
        return 0
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, window = full, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        m = masks.get(x, 0)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (a + b - L) of two k-mer sequences, exact where it is at least `least`; what can't reach it may come out lower."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    s = min(n, m)
    differ = np.flatnonzero(a[:s] != b[:s])
    head = int(differ[0]) if len(differ) else s
    differ = np.flatnonzero(a[n - s + head :][::-1] != b[m - s + head :][::-1])
    tail = int(differ[0]) if len(differ) else s - head
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    # L >= least * (n + m) / (1 + least), so at most so many k-mers stay alone, and no aligned pair is further from the diagonal.
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    if (1 + least) * (head + tail + sum((Counter(x) & Counter(y)).values())) < least * (n + m) - 1e-9:
        return 0.0  # too few k-mers in common in any order
    got = head + tail + common_subsequence(x, y, band)
    return got / (n + m - got)


# The job


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = [n for n in b.schema.names if n != "_text"]
        for lo, hi, data, at in B.slices(b.column(b.schema.names.index("_text"))):
            h, bounds = kmers(data, at)
            got = [sketch(h[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])])
            flat = np.concatenate(got) if got else np.zeros(0, np.uint64)
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], [*rest, "_n", "_sketch"])


def _links(pairs: DataFrame, rows: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that align, from their texts, as a table. The text of a node with many pairs goes to several tasks."""

    def check(batches):
        for b in batches:
            keep = []
            left, right = (next_kmers(b.column(c)) for c in (2, 3))
            for x, y in zip(left, right, strict=True):
                keep.append(aligned(x, y, similarity) >= similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    def next_kmers(column):
        for lo, hi, data, at in B.slices(column):
            h, bounds = kmers(data, at)
            for i in range(hi - lo):
                yield h[bounds[i] : bounds[i + 1]]

    spark = pairs.sparkSession
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")
    nodes, nodes_path = C.written(pairs.select(F.explode(F.array("a", "b")).alias("_row")).groupBy("_row").agg(blocks), "pair-nodes")
    texts = rows.select("_row", F.coalesce(F.col(f"_kept.`{text_col}`").cast("string"), F.lit("")).alias("t")).join(C.small_or_not(nodes), "_row")
    texts, texts_path = C.written(texts, "pair-texts")
    heavy = C.small_or_not(nodes.filter("_blocks > 1"))
    both = pairs
    for side, other in (("a", "b"), ("b", "a")):
        deal = F.pmod(F.xxhash64(other), F.coalesce("_blocks", F.lit(1))).cast("int").alias(f"_{side}")
        both = both.join(heavy.withColumnRenamed("_row", side), side, "left").select(*both.columns, deal)
    for side in ("a", "b"):
        copies = texts.select(F.col("_row").alias(side), F.col("t").alias(f"t{side}"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias(f"_{side}"))
        both = both.join(copies, [side, f"_{side}"])
    out, _ = C.written(both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint"), "links")
    for path in (nodes_path, texts_path):
        C.drop_path(spark, path)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of all nodes in links (a, b): comp is the least node reached. Alternating large and small stars, a table a round.

    It ends when the edges are stars: each node has one edge down and none up, or only edges up. Least neighbours are summed before the
    shuffle; a hub's edges meet them by broadcast where a count allows it, else by a join that Spark splits if it is skewed.
    """
    edges, path = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), None
    for _ in range(rounds):
        few = F.broadcast if edges.count() * 2 <= C.BROADCAST_ROWS else lambda df: df
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(few(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges, new = C.written(small, "edges")
        if path:
            C.drop_path(links.sparkSession, path)
        path = new
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("down").alias("n"), F.min("down").alias("least")).filter("n > 1 OR n > 0 AND least = 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())
    raise RuntimeError(f"the components didn't settle in {rounds} rounds")


def _met(solid: DataFrame) -> DataFrame:
    """(bucket, node, n) of buckets that have two nodes or more, as a table."""
    buckets, path = C.written(solid.select(F.explode("_sketch").alias("bucket"), "node", "n"), "buckets")
    # Most buckets have one node: only their numbers are counted and shuffled beside the rows, nothing else of them.
    full = buckets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    out, _ = C.written(buckets.join(full, "bucket", "left_semi"), "met-buckets")
    C.drop_path(solid.sparkSession, path)
    C.release(solid.sparkSession)
    return out


def _star_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of each bucket's members and its two centres whose lengths allow a link."""
    centre = lambda order: F.min(F.struct(order.alias("o"), "node", "n"))
    centres, _ = C.written(met.groupBy("bucket").agg(centre(F.col("node")).alias("c1"), centre(F.xxhash64("node")).alias("c2")).select("bucket", F.explode(F.array_distinct(F.array(*[F.struct(f"{c}.node", f"{c}.n") for c in ("c1", "c2")]))).alias("c")), "centres")
    each = met.join(C.small_or_not(centres), "bucket").filter(F.col("node") != F.col("c.node")).filter(F.least("n", "c.n") >= similarity * F.greatest("n", "c.n"))
    return each.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _apart(met: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in buckets whose nodes aren't all in one component, as a table."""
    members = met.select("bucket", "node").join(C.small_or_not(comp), "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("bucket")
    mixed, path = C.written(mixed, "mixed-buckets")
    out, _ = C.written(members.join(C.small_or_not(mixed), "bucket", "left_semi").select("node", "comp").distinct(), "apart")
    C.drop_path(met.sparkSession, path)
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in B.slices(b.column(b.schema.names.index("_text"))):
            h, bounds = kmers(data, at)
            flat = [occurrence_labelled(h[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            bits = np.zeros((hi - lo, 64 * LONGS), np.uint8)
            np.bitwise_xor.at(bits, (np.repeat(np.arange(hi - lo), np.diff(bounds)), (B.mix(flat) % np.uint64(64 * LONGS)).astype(np.int64)), 1)
            longs = np.packbits(bits, axis=1).view(np.int64).ravel()
            part = b.slice(lo, hi - lo)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for at, x in ((bounds, flat.view(np.int64)), (np.arange(hi - lo + 1) * LONGS, longs))]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("comp"), pa.array(np.diff(bounds), pa.int64()), *lists], ["node", "comp", "n", "_h", "_p"])


def _possible(nodes: DataFrame, rows: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, comp) in different components that may align at `similarity`: none that does is missing.

    L is at most the overlap of the labelled k-mers as sets, so a link needs an overlap of t = s / (1 + s) * (n + m). In any one order of
    all k-mers (those of one component first, then the rarest), the first common one is among the first n - t + 1 of each text, and what
    follows it must suffice for the rest of t. Per k-mer one side leaves out the largest component, and blocks bound what a task holds.
    Bits in which the parities of two texts differ stand for at least as many k-mers that only one of them has.
    """
    spark = nodes.sparkSession
    left = rows.select(F.col("_row").alias("node"), F.coalesce(F.col(f"_kept.`{text_col}`").cast("string"), F.lit("")).alias("_text")).join(C.small_or_not(nodes), "node").select("node", "comp", "_text")
    left, left_path = C.written(left.mapInArrow(_labelled, "node bigint, comp bigint, n bigint, _h array<bigint>, _p array<bigint>"), "left-kmers")
    each = left.select("node", "comp", "n", F.explode("_h").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("h", "c")
    several = each.join(counts, "h").groupBy("node").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("_o"))
    # The prefix of the longer text of a pair; that of the shorter one is checked below.
    long = lambda n: n - F.ceil(similarity * n - 1e-9) + 1
    short = lambda n: n - F.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
    first = several.select("node", "comp", "n", F.posexplode("_o").alias("_i", "_x"), (F.col("n") - F.size("_o")).alias("_alone")).select("node", "comp", "n", (F.col("_alone") + F.col("_i")).alias("pos"), F.col("_x.h").alias("h")).filter(F.col("pos") < long(F.col("n")))
    first, first_path = C.written(first, "prefixes")
    by = first.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("k"), F.sum("c").alias("c"), F.max_by("comp", "c").alias("top")).filter("k > 1").select("h", "top", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    first = first.join(by, "h")
    x = first.filter("comp != top").select("h", "top", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "pos")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"))
    y = first.select("h", *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "n", "pos")], F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("_b"))
    once = (F.col("y_comp") == F.col("top")) | (F.col("x_node") < F.col("y_node"))
    lengths = F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - 1e-9
    prefix = F.when(F.col("x_n") <= F.col("y_n"), F.col("x_pos") < short(F.col("x_n"))).otherwise(F.col("y_pos") < short(F.col("y_n")))
    rest = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - 1e-9
    # A number of partitions holds them apart: few bytes here are many comparisons.
    pairs = x.repartition(C.parts(spark), "h", "_b").join(y.repartition(C.parts(spark), "h", "_b"), ["h", "_b"]).filter((F.col("x_comp") != F.col("y_comp")) & once & lengths & prefix & rest)
    pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    parities = C.small_or_not(left.select("node", "n", "_p"), C.BROADCAST_ROWS // 4)
    pairs = pairs.join(parities.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("_p").alias("ap")), "a").join(parities.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("_p").alias("bp")), "b")
    differ = sum((F.bit_count(F.get("ap", F.lit(i)).bitwiseXOR(F.get("bp", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    out, _ = C.written(pairs.filter(differ <= (1 - similarity) / (1 + similarity) * (F.col("an") + F.col("bn")) + 1e-9).select("a", "b"), "possible")
    for path in (left_path, first_path):
        C.drop_path(spark, path)
    C.release(spark)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: _kept (its columns), _row, class_id (the least id of its class), first (the one row that stands for the class)."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), text.alias("_text"), F.md5(text.cast("binary")).alias("_key"))
    kinds = StructType([*src.drop("_text").schema.fields, StructField("_n", LongType()), StructField("_sketch", ArrayType(LongType()))])
    rows, _ = C.written(src.mapInArrow(_sketched, kinds).withColumn("_row", F.monotonically_increasing_id()), "sketched")
    # Equal texts, summed before the shuffle; a text without a word is equal to any other such.
    key = F.when(F.col("_n") == 0, "").otherwise(F.col("_key")).alias("_key")
    each = rows.select(key, F.col(f"_kept.`{id_col}`").alias("_id"), "_row")
    reps, _ = C.written(each.groupBy("_key").agg(F.min("_row").alias("node"), F.min("_id").alias("_id"), F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("w")), "texts")
    # Tables that grow with the documents meet by shuffles at every size.
    solid = rows.filter("_n > 0").select(F.col("_row").alias("node"), F.col("_n").alias("n"), "_sketch").join(reps.select("node"), "node", "left_semi")
    met = _met(solid)
    pairs, path = C.written(_star_pairs(met, similarity), "pairs")
    links = _links(pairs, rows, text_col, similarity)
    comp, _ = C.written(components(links), "components")
    C.drop_path(spark, path)
    C.release(spark)
    apart = _apart(met, comp)
    # What two centres didn't join is compared without a cap.
    found = _links(_possible(apart, rows, text_col, similarity), rows, text_col, similarity)
    C.release(spark)
    # Links between components: the components of components.
    of = C.small_or_not(comp)
    for side in ("a", "b"):
        found = found.join(of.select(F.col("node").alias(side), F.col("comp").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    top = components(C.written(found.distinct(), "component-links")[0]).withColumnRenamed("comp", "top").withColumnRenamed("node", "comp")
    # A node of no link is its own component, also where a link between components names it.
    of = reps.join(of, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(C.small_or_not(C.written(top, "tops")[0]), "comp", "left").withColumn("comp", F.coalesce("top", "comp"))
    of, _ = C.written(of.select("_key", "comp", "_id", "w"), "named")
    least = of.groupBy("comp").agg(F.min("_id").alias("class_id"), F.min("w").alias("w"))
    of = of.select("_key", "comp").join(least, "comp").select("_key", "class_id", F.col("w._row").alias("_first"))
    return rows.select("_kept", "_row", key).join(of, "_key").select("_kept", "_row", "class_id", (F.col("_row") == F.col("_first")).alias("first"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each class: the one with the least id (null ids last, equal ones by place); all columns of docs."""
    return classes(docs, **options).filter("first").select(*[F.col(f"_kept.`{c}`").alias(c) for c in docs.columns])


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select(F.col("_kept.doc_id").alias("doc_id"), "class_id")


QUERIES = {"op2_order_minhash": op2_order_minhash}
ORACLE_SQL: dict[str, str] = {}
