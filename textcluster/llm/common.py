"""Shared helpers: tables, written intermediates, hot-key lookups, connected components, samples."""

from __future__ import annotations

import pickle
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcluster.session import scratch_path

MIN_LONG = -(1 << 63)
#: groups that hold at least this share of all grouped rows are looked up by broadcast: at most 1 / HOT_SHARE of them exist
HOT_SHARE = 0.002
#: Spark's setting that a query's shuffle files are deleted at its end, and not when the driver's garbage is collected
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: places of a bitmap of keys: 1 MB of bits
BITS = 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder and read back: cuts the
    lineage, so an executor lost later costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _freed_shuffles(spark: SparkSession):
    """A write's shuffle files go when it ends: whatever follows reads the written table."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def ship(spark: SparkSession, value):
    """A broadcast of a bounded object whose classes travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpack(shared):
    return pickle.loads(shared.value)


def total(df: DataFrame, column: str) -> int:
    """Sum of a column (0 for an empty table): one number to the driver."""
    return int(df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


def fingerprint(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: a 128-bit identity of the values."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else kept. Pure ASCII strings take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, values: list[str], n_total: int) -> DataFrame:
    """Left-join ``values`` of ``groups`` (one row per key, ``count`` = rows of that key) to ``rows``.

    A key may hold a third of all rows, so groups with at least HOT_SHARE of the ``n_total`` grouped
    rows are broadcast (there are at most 1 / HOT_SHARE of them, whatever the input); the other keys
    are small and take an ordinary shuffled join, in which the hot rows are dealt out at random.
    """
    limit = max(2, int(n_total * HOT_SHARE))
    hot = groups.filter(F.col(count) >= limit).select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values])
    cold = groups.filter(F.col(count) < limit).select(
        *[F.col(k).alias(f"__cold_{k}") for k in keys], *[F.col(v).alias(f"__cold_{v}") for v in values], F.lit(0).alias("__cold_deal")
    )
    marked = rows.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), keys, "left")
    dealt = marked.withColumn("__deal", F.when(F.col("__is_hot"), 1 + F.abs(F.xxhash64(*[F.col(c) for c in _plain(rows)])) % 997).otherwise(0))
    on = [F.col(k) == F.col(f"__cold_{k}") for k in keys] + [F.col("__deal") == F.col("__cold_deal")]
    joined = dealt.join(cold, on, "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values])


def _plain(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("bigint", "int")] or [df.columns[0]]


def bitmap(keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """(word, bits): which of 2 ** bits hash places the keys take; at most 2 ** (bits - 6) rows."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(__place % 64 as int))")
    return keys.select(place.alias("__place")).groupBy((F.col("__place") / 64).cast("int").alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def maybe_in(rows: DataFrame, bitmap: DataFrame, on: list[Column], bits: int = BITS) -> DataFrame:
    """The rows with ``__maybe``: whether their key may be in the bitmap, which is broadcast."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    placed = rows.withColumn("__place", place).withColumn("__word", (F.col("__place") / 64).cast("int"))
    joined = placed.join(F.broadcast(bitmap), "__word", "left")
    there = F.coalesce(F.getbit("__bits", (F.col("__place") % 64).cast("int")) == 1, F.lit(False))
    return joined.withColumn("__maybe", there).drop("__place", "__word", "__bits")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over the edges, itself included.

    Alternates large-star and small-star steps (each a grouping by node with partial aggregation and
    a join) until the star forest no longer changes. Only two counters per round reach the driver.
    Nodes without an edge to another node are not listed.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    cur = written(cur, "cc")
    state = _state(cur)
    for _ in range(max_rounds):
        pairs = 2 * state[0]  # each pair is seen from both of its ends
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour of u is linked to the smallest node u knows
        large = _star(both, low, pairs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _star(large, low2, pairs).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low2.select("u", F.col("m").alias("v"))
        cur = written(small.unionByName(own).filter("u <> v").distinct(), "cc")
        before, state = state, _state(cur)
        if state == before:
            break
    else:
        raise RuntimeError("the component search did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    """Count and hash sum: equal for equal sets of pairs."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, low: DataFrame, n_pairs: int) -> DataFrame:
    """Attach the smallest known node of u to its pairs; a hub's pairs may be a third of all."""
    return lookup(pairs, written(low, "cc-low"), ["u"], "n", ["m"], n_pairs)
