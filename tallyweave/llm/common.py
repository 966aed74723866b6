"""Helpers shared by the corpus operators: inputs, shared storage, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that components() puts in one file of a round's tables.
PART_ROWS = 1_000_000
#: lookup(): keys that hold more than one in MOST of the rows (HOT rows at least) are met by broadcast; so at most MOST keys.
MOST, HOT = 10_000, 64
#: Parts over which lookup() deals the rows of a hot key.
SALTS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder serves a local session, as in tests; on a cluster that would be another
    folder on every machine, so it is refused.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there when an executor is lost.

    The table goes when the driver ends, or with drop_stored().
    """
    path = f"{shared_dir(df.sparkSession)}/tallyweave-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Removes the tables that stored() wrote; results that still read them are lost."""
    while _written:
        path, spark = _written.popitem()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone, and the folder with it
            return


atexit.register(drop_stored)


def scratch(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lookup(rows: DataFrame, keys: list[str], found: DataFrame, spread: Column, hot: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """rows with the other columns of found, null where found has no such key: a left join in which a key may hold any share of rows.

    found is unique in keys, and no column is in both but the keys. The keys that hold more than one in MOST of the
    rows are MOST at most, so their part of found is broadcast (a caller that knows them gives found's rows for them as
    `hot`, one that knows how many rows there are says `total`); the rest meets by a shuffle, with the rows of hot and null keys dealt over SALTS parts by `spread` (a hash
    of stable columns), so that no task gets a large key whole.
    """
    salt, is_hot, n = scratch("salt"), scratch("hot"), scratch("n")
    more = [c for c in found.columns if c not in keys]
    if hot is None:
        often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > hot_over(rows.count() if total is None else total)).drop(n)
        hot = often.join(found, keys)
    named = {c: scratch("hot_" + c) for c in more}
    apart = hot.select(*keys, *[F.col(c).alias(named[c]) for c in more], F.lit(True).alias(is_hot))
    marked = rows.join(F.broadcast(apart), keys, "left")
    missing = reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys))
    marked = marked.withColumn(salt, F.when(F.col(is_hot) | missing, F.pmod(spread, F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int"))
    met = marked.join(found.withColumn(salt, F.lit(0)), [*keys, salt], "left")
    return met.select(*rows.columns, *[F.when(F.col(is_hot), F.col(named[c])).otherwise(F.col(c)).alias(c) for c in more])


def hot_over(total: int) -> int:
    """A key with more rows than this, of so many in all, is hot."""
    return max(HOT, total // MOST)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by randomised contraction.

    nodes: one column `id` (unique, long); edges: `a`, `b` (long). Returns (id, component_id) with the smallest id
    of each component. In every round each vertex joins the neighbour (or itself) of the least pseudo-random
    priority, so a constant share of the remaining vertices disappears whatever the graph's shape. A vertex with very
    many links is reduced by map-side aggregation and met by lookup(), which leaves its rows where they are. Each
    round's links and where their ends go are cut with one checkpoint(), in as many files as the rows ask for;
    nothing is collected but row counts.
    """
    least_parts = nodes.sparkSession.sparkContext.defaultParallelism
    shared_dir(nodes.sparkSession)
    left = edges.where("a <> b").select("a", "b").checkpoint()
    maps: list[DataFrame] = []
    n, k = left.count(), 0
    while n:
        if k == max_rounds:
            raise RuntimeError("components: not contracted after max_rounds")
        parts = max(least_parts, -(-n // PART_ROWS))
        rank = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), c.alias("v"))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        into = both.groupBy("u").agg(F.least(F.min(rank(F.col("v"))), F.min(rank(F.col("u"))))["v"].alias("to"), F.count(F.lit(1)).alias("d"))
        hubs = into.where(F.col("d") > hot_over(2 * n))
        ends = left
        for c, other in (("a", "b"), ("b", "a")):
            as_c = lambda df, c=c: df.select(F.col("u").alias(c), F.col("to").alias(f"t{c}"))
            ends = lookup(ends, [c], as_c(into), F.xxhash64(other), as_c(hubs))
        ends = ends.select("a", "b", "ta", "tb").coalesce(parts).checkpoint()
        maps.append(ends.select(F.col("a").alias("u"), F.col("ta").alias("to")).unionByName(ends.select(F.col("b").alias("u"), F.col("tb").alias("to"))).distinct())
        left = ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        n, k = left.count(), k + 1
    # Vertices that were ever moved, with the vertex that stands for them at the end.
    if not maps:
        return nodes.select("id", F.col("id").alias("component_id"))
    moved = maps[0].select(F.col("u").alias("id"), F.col("to").alias("at")).checkpoint()
    total = moved.count()
    parts = max(least_parts, -(-total // PART_ROWS))
    for into in maps[1:]:
        met = lookup(moved, ["at"], into.select(F.col("u").alias("at"), "to"), F.xxhash64("id"), total=total)
        moved = met.select("id", F.coalesce("to", "at").alias("at")).coalesce(parts).checkpoint()
    least = moved.groupBy("at").agg(F.min("id").alias("component_id"))
    named = lookup(moved, ["at"], least, F.xxhash64("id"), total=total).select("id", "component_id")
    return nodes.join(named, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))


def gapless(df: DataFrame, group: list[str], spread: Column, order: list[Column], name: str, salts: int) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each group, without one task holding a whole group.

    Rows of a group are dealt to `salts` parts by `spread` (a hash of stable columns), ranked inside their part, and
    shifted by the number of rows in the group's earlier parts. The table of shifts has groups x salts rows at most.
    """
    part, count, shift = scratch("part"), scratch("count"), scratch("shift")
    dealt = df.withColumn(part, F.pmod(spread, F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*group, part).agg(F.count(F.lit(1)).alias(count))
    shifts = counts.withColumn(shift, F.sum(count).over(Window.partitionBy(*group).orderBy(part)) - F.col(count)).drop(count)
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)).cast("long") - 1)
    same = reduce(lambda x, y: x & y, (ranked[c].eqNullSafe(shifts[c]) for c in [*group, part]))
    keep = [ranked[c] for c in df.columns]
    return ranked.join(shifts, same).select(*keep, (ranked[name] + shifts[shift]).alias(name))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys (not null) in rows that come sorted by them, one table a run."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        change = np.zeros(held.num_rows - 1, bool)
        for k in keys:
            c = held[k].to_numpy()
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None:
        yield held
