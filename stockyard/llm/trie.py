"""A prefix trie of conversations, by whole-sequence collapse.

Every conversation c is rebuilt: the first h turns of conversation c - c % 20 (all if it has fewer, none if it isn't there), then its own turns
after its first h, where h = crc32(decimal c) % 4. Then:

1. Identical rebuilt conversations are one weighted sequence: its number of conversations, the least of them, and the list of those that end there.
2. A sequence that is a proper prefix of another is no leaf: an anti join of the sequences with the nodes that some sequence goes on from.
3. The prefixes of the weighted sequences (not of all conversations) are summed by node.

A prefix is known by its depth and by the sum, over its turns, of 128-bit hashes of (position, SHA-256 of role and text). So a
prefix's key is a running sum, a whole conversation's is a plain one, and neither needs a conversation in one task: turns are
numbered and summed in pieces (operators.running), so one conversation may hold any share of the rows.

What a subtree saves is sum(n_convs * words) - sum(words) over its nodes. The first is a sum over weighted sequences of the words that follow. For
the second, each node belongs to the sequence of its least conversation; the nodes of one sequence are the lower end of its path, so
their depth and words are two numbers for each sequence.

The conversations that end at a node are hashed in ascending order, which no two tasks can share; ids go there in joined blocks, sorted by
Spark, and pass through as a stream, so the task holds a batch of blocks, however many copies there are.

Turns go by number, null first; turns of one number by the SHA-256 of role and text; repeated rows stay. Null role and text are empty. Rows without
conv_id belong to no conversation and have no part. % is that of SQL (the sign of c). A conversation without any turn left ends at the root. An empty table gives
no row. Only the four named columns are read, so others can't clash. Sums count up to 2**31 turns a conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.llm import common as C
from stockyard.operators.running import running

GROUP, MOST = 20, 4
#: Ids below one multiple of BLOCK make one string; turns of one sequence are summed in pieces of PIECE.
BLOCK, PIECE = 4096, 65536
LIMBS = ["k1", "k2", "k3", "k4"]
KEY = ["depth", *LIMBS]
_WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (32 bytes for role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said.alias("said"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, k1 .. k4 (the turn's share of the key), words; and a row of depth 0 for each conversation."""
    # Equal rows may share a number of their own, so that many of them can be parted.
    rows = turns_of(conversations).withColumn("at", F.monotonically_increasing_id())
    numbered = running(rows, [F.col("turn").asc_nulls_first(), F.col("said"), F.col("at")], ["conv_id"], number="i")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST))
    head = F.col("conv_id") - F.col("conv_id") % GROUP
    first = numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("i") < MOST)).select(F.col("conv_id").alias("head"), "i", "said", "words")
    convs = numbered.select("conv_id").distinct().select("conv_id", h.alias("h"), head.alias("head"))
    taken = convs.join(first, "head").where("i <= h").select("conv_id", F.col("i").alias("depth"), "said", "words")
    had = first.groupBy("head").agg(F.max("i").alias("had"))
    own = numbered.select("conv_id", h.alias("h"), head.alias("head"), "i", "said", "words").where("i > h").join(had, "head", "left")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.least("h", F.coalesce("had", F.lit(0)))).alias("depth"), "said", "words")
    a, b = (F.xxhash64(F.lit(seed), F.col("depth"), F.col("said")) for seed in (1, 2))
    limbs = [F.shiftrightunsigned(a, 32), a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(0xFFFFFFFF))]
    rows = taken.unionByName(own).select("conv_id", F.col("depth").cast("bigint").alias("depth"), *[v.alias(n) for n, v in zip(LIMBS, limbs, strict=True)], "words")
    zero = [F.lit(0).cast("bigint").alias(c) for c in [*KEY, "words"]]
    return rows.unionByName(convs.select("conv_id", *zero))


def _ends(whole: DataFrame) -> DataFrame:
    """least, ends_sha256 of each sequence: its conversations ascending, through one running hash each."""
    blocks = whole.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.min("conv_id").alias("lo"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sorted_ = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "lo").select(*KEY, "lo", "ids")

    def hashed(batches):
        now, least, sha = None, None, None
        for b in batches:
            done: list[tuple[int, str]] = []
            keys = zip(*(b.column(k).to_pylist() for k in range(len(KEY))), strict=True)
            for key, lo, ids in zip(keys, b.column(len(KEY)).to_pylist(), b.column(len(KEY) + 1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((least, sha.hexdigest()))
                    now, least, sha = key, lo, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["least", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([sha.hexdigest()])], ["least", "ends_sha256"])

    return sorted_.mapInArrow(hashed, "least bigint, ends_sha256 string")


def sequences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation: conv_id and the key and words of all its turns; a row for each distinct one: least, weight, key, words)."""
    whole, _ = C.written(rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in [*LIMBS, "words"]]), "whole")
    return whole, whole.groupBy(*KEY).agg(F.min("conv_id").alias("least"), F.count("*").alias("weight"), F.first("words").alias("words"))


def prefixes(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """least, weight, n (turns of the sequence), depth, key, the parent's key, words, rest (words of this turn and those after it): for each prefix but the root."""
    s = distinct.select(F.col("least").alias("conv_id"), "weight", F.col("depth").alias("n"), F.col("words").alias("total"))
    mine = rows.where("depth > 0").join(s, "conv_id").withColumn("piece", F.floor((F.col("depth") - 1) / PIECE))
    sums = [*LIMBS, "words"]
    so_far = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = mine.withColumns({f"r_{c}": F.sum(c).over(so_far) for c in sums})
    # Only sequences of more than PIECE turns have anything to carry: a row for each of their pieces.
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = mine.where(F.col("n") > PIECE).groupBy("conv_id", "piece").agg(*[F.sum(c).alias(f"s_{c}") for c in sums])
    carried = carried.select("conv_id", "piece", *[F.sum(f"s_{c}").over(before).alias(f"c_{c}") for c in sums])
    all_ = local.join(carried, ["conv_id", "piece"], "left")
    so = {c: F.col(f"r_{c}") + F.coalesce(f"c_{c}", F.lit(0)) for c in sums}
    return all_.select(F.col("conv_id").alias("least"), "weight", "n", "depth", *[so[c].alias(c) for c in LIMBS], *[(so[c] - F.col(c)).alias(f"p{c}") for c in LIMBS], "words", (F.col("total") - so["words"] + F.col("words")).alias("rest"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, _ = C.written(rebuilt(conversations), "rebuilt")
    whole, distinct = sequences(rows)
    distinct, _ = C.written(distinct, "sequences")
    paths, _ = C.written(prefixes(rows, distinct), "prefixes")
    parent = [f"p{c}" for c in LIMBS]
    nodes = paths.groupBy(*KEY).agg(F.min("least").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("n").alias("deepest"), F.sum(F.col("weight") * F.col("rest")).alias("members_words"), F.first("words").alias("words"), *[F.first(p).alias(p) for p in parent])
    nodes, _ = C.written(nodes, "nodes")

    # What a sequence owns of its path: from which depth on, and how many words.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.sum("words").alias("own")).withColumnRenamed("conv_id", "least")
    inner = nodes.where("deepest > depth").select(*KEY)
    deep = distinct.where("depth > 0")
    leaves = deep.join(inner, KEY, "left_anti").select("least", F.lit(1).alias("leaf"))
    facts = deep.select("least").join(owned, "least", "left").join(leaves, "least", "left")
    seen = paths.select("least", *KEY, "rest").join(facts, "least")
    # Everything that is known of a node by its key, in one aggregate.
    none = {"conv_id": "bigint", "n_convs": "bigint", "saved": "bigint", "leaf": "bigint", "child": "bigint", "ends_sha256": "string", **dict.fromkeys(parent, "bigint")}
    fill = lambda df, **have: df.select(*KEY, *[(have[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in none.items()])
    told = fill(nodes, conv_id=F.col("conv_id"), n_convs=F.col("n_convs"), saved=F.col("members_words"), **{p: F.col(p) for p in parent})
    told = told.unionByName(fill(seen, leaf=F.coalesce("leaf", F.lit(0)), saved=-F.when(F.col("depth") >= F.col("from"), F.col("rest")).otherwise(F.coalesce("own", F.lit(0)))))
    told = told.unionByName(fill(nodes.where("depth > 1").select((F.col("depth") - 1).alias("depth"), *[F.col(f"p{c}").alias(c) for c in LIMBS]), child=F.lit(1)))
    told = told.unionByName(fill(deep.join(_ends(whole), "least"), ends_sha256=F.col("ends_sha256")))
    full = told.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "ends_sha256", *parent)], F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"))
    full = full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))

    # The parent is of the same sequence, but for the first node that a sequence owns.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"p{c}") for c in LIMBS], F.col("conv_id").alias("up"))
    from_ = owned.select(F.col("least").alias("conv_id"), F.col("from"))
    tops = nodes.select("conv_id", "depth", *parent).join(from_, "conv_id").where("depth = from AND depth > 1").join(parents, ["depth", *parent]).select("conv_id", "depth", "up")
    top = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    body = full.join(tops, ["conv_id", "depth"], "left").join(F.broadcast(top.select(F.col("conv_id").alias("root_id"))))  # one row
    body = body.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_id")).otherwise(F.coalesce("up", "conv_id")))

    ends = distinct.where("depth = 0").join(_ends(whole.where("depth = 0")), "least", "left").agg(F.max("ends_sha256").alias("ends_sha256"))
    below = nodes.agg(F.coalesce(F.sum(F.expr("if(depth = 1, members_words, 0)")) - F.sum("words"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum(F.expr("if(depth = 1, 1, 0)")), F.lit(0)).alias("n_children"))
    n_leaves = leaves.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_leaves"))
    root = top.where("n_convs > 0").crossJoin(F.broadcast(below)).crossJoin(F.broadcast(n_leaves)).crossJoin(F.broadcast(ends))  # one row each
    root = root.withColumns({"depth": F.lit(0), "parent_conv_id": F.lit(None), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    pick = lambda df: df.select(*[F.col(c).cast("bigint").alias(c) for c in columns], "ends_sha256")
    return pick(body).unionByName(pick(root))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(C.table(spark, sf_dir, "conversations"))


QUERIES = {"op11_trie": op11_trie}
ORACLE_SQL = {
    # CRC-32 by its table; prefixes as lists of whole turns.
    "op11_trie": f"""
WITH RECURSIVE eight(n, k, c) AS (
  SELECT n, 0, n FROM range(256) r(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM eight WHERE k < 8
), crc(conv_id, s, k, c) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, s, crc.k + 1, xor(crc.c >> 8, eight.c) FROM crc JOIN eight ON eight.k = 8 AND n = xor(crc.c & 255, ascii(substr(s, crc.k + 1, 1))) WHERE crc.k < length(s)
), h AS (SELECT conv_id, xor(c, 4294967295) % {MOST} AS h FROM crc WHERE k = length(s)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS ts FROM t GROUP BY conv_id),
r AS (SELECT w.conv_id, list_concat(coalesce(b.ts[1:CAST(h AS INTEGER)], []), w.ts[CAST(h AS INTEGER) + 1:]) AS ts FROM whole w JOIN h USING (conv_id) LEFT JOIN whole b ON b.conv_id = w.conv_id - w.conv_id % {GROUP}),
p AS (SELECT conv_id, d, ts[1:d] AS pre, len(ts) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(ts[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM r, unnest(range(0, len(ts) + 1)) x(d)),
node AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends, max(n) = d AS leaf FROM p GROUP BY pre, d),
below AS (SELECT a.pre, a.d, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (u.leaf) AS n_leaves, count(*) FILTER (u.d = a.d + 1) AS n_children
  FROM node u JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.pre, a.d)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, below.n_children, below.n_leaves, CAST(below.saved_tokens AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.pre = node.pre LEFT JOIN node up ON up.d = node.d - 1 AND node.d > 0 AND up.pre = node.pre[1:node.d - 1]
""",
}
