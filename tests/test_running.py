"""Running numbers and sums against plain loops, with groups over many pieces."""

import random

import pytest
from pyspark.sql import functions as F

from stockyard.operators.running import running


def plain(rows, grouped):
    at, out = {}, []
    for g, x, v in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), -r[1]) if grouped else (-r[1],)):
        n, s = at.get(g if grouped else 0, (0, None))
        s = s if v is None else (s or 0) + v
        at[g if grouped else 0] = n + 1, s
        out.append((g, x, v, n + 1, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_against_loop(spark, n, grouped):
    rng = random.Random(n)
    # Half of all rows are of one group; a null group and null values.
    rows = [(rng.choice([1, 1, 1, None, 2, *range(20)]), x, None if x % 3 == 0 else rng.randrange(-50, 50)) for x in range(n)]
    df = spark.createDataFrame(rows, "g int, x int, v bigint").repartition(5)
    got = running(df, [F.col("x").desc()], ["g"] if grouped else None, {"s": "v"}, "n")
    assert got.columns == ["g", "x", "v", "s", "n"]
    assert sorted(((r.g, r.x, r.v, r.n, r.s) for r in got.collect()), key=str) == plain(rows, grouped)


def test_pieces_are_even(spark):
    """One group of all rows: no task numbers more than its share."""
    df = spark.range(40_000).withColumn("g", F.lit(1))
    got = running(df, [F.col("id")], ["g"], number="n")
    assert got.where("n <> id + 1").count() == 0
    from stockyard.operators.running import pieces

    sizes = [r["count"] for r in pieces(df, [F.col("id")], ["g"]).groupBy("_piece").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 15_000
