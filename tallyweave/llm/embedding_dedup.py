"""Near-duplicate embeddings through a pivot-permutation index.

Every vector is described by its NEAREST nearest reference points (pivots), nearest first: its permutation. The inverted
list of a pivot holds the vectors that have it among their first FILED. Vectors that meet in a list are candidates when
their permutations share SHARED pivots, and candidates are verified by their cosine.

Lists hold the permutation and a compact copy of the vector (16 bits a component), whose rounding error has a known
bound: it settles all pairs but those within a hair of the limit, which alone leave the list and are settled by the
cosine of their vectors in double precision. A pair counts in one list only, that of its least common pivot. So pairs do
not travel: what leaves a list are link counts, a spanning forest and the few unsettled pairs. A list longer than BLOCK
is cut into blocks that meet each other in tasks of their own.

There are PIVOT_ROOT pivots for the square root of the number of vectors, so that work a vector grows with that root and
not with their number. Pivots are a bounded, deterministic choice of the vectors of one width; a width that is rare has
no pivots, and its vectors are one list. Equal vectors are one vertex with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import components, lookup, runs, stored, table
from .simhash import Forest

COSINE = 0.9
#: Length of a permutation, how many of its pivots a vector is filed under, and how many two candidates share.
NEAREST, FILED, SHARED = 8, 4, 2
BLOCK = 8192
#: Pivots: PIVOT_ROOT times the root of the vectors, out of twice as many (PIVOT_SAMPLE at least), under a cosine of PIVOTS_APART to each other.
PIVOT_ROOT, PIVOT_SAMPLE, PIVOTS_APART = 4, 4096, 0.5
#: Widths that have pivots of their own: the commonest WIDTHS, where they have more than RARE vectors.
WIDTHS, RARE = 16, 256
#: The compact copy writes a component x of a unit vector as round(x * FULL).
FULL = 32767


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; the largest component first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def permutations(unit: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Each unit vector's nearest pivots by cosine, nearest first; ties go to the lower number."""
    near = unit.astype(np.float32) @ pivots.T.astype(np.float32)
    nearest = min(nearest, near.shape[1])
    # The few nearest by a partial sort first; only they are put in order.
    some = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest] if nearest < near.shape[1] else np.tile(np.arange(nearest), (len(near), 1))
    some = np.sort(some, axis=1)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def choose_pivots(nodes: DataFrame, root: float = PIVOT_ROOT, sample: int = PIVOT_SAMPLE, apart: float = PIVOTS_APART) -> dict[int, np.ndarray]:
    """Unit pivots by width, out of the vectors of the least hashes, each at a cosine under `apart` from the others.

    Pivots that keep apart do not crowd in one large class, whose members they could not tell from each other's
    neighbours. The choice depends on the vectors alone, so any run takes the same ones.
    """
    width = F.size("embedding")
    common = nodes.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(WIDTHS).collect()
    out = {}
    for w, n in ((r["w"], r["n"]) for r in common if r["n"] > RARE):
        most = max(NEAREST, math.ceil(root * math.sqrt(n)))
        rows = nodes.where(width == w).orderBy(F.xxhash64("embedding"), "node").limit(max(sample, 2 * most)).select("embedding").toArrow()
        unit = unit_rows(rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w))
        free, chosen = np.ones(len(unit), bool), []
        for i in range(len(unit)):
            if free[i] and len(chosen) < most:
                chosen.append(i)
                free &= unit @ unit[i] < apart
        out[w] = unit[chosen].astype(np.float32)
    return out


def _describe(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(node, weight, near, code): the permutation by pivot numbers, and the compact copy.

    Pivots are numbered through all widths; a width without pivots has -width as its only one.
    """
    first, at = {}, 0
    for w, p in pivots.items():
        first[w], at = at, at + len(p)
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            column = part["embedding"]
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
            widths = np.diff(ends)
            for w in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == w)
                unit = unit_rows(flat[ends[rows][:, None] + np.arange(w)])
                near = permutations(unit, pivots[w]) + first[w] if w in pivots else np.full((len(rows), 1), -w)
                code = np.rint(unit * FULL).astype("<i2")
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part["node"].take(take), part["weight"].take(take), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "weight", "near", "code"]
                )


def _verify(group: pa.Table, cosine: float, filed: int, shared: int) -> pa.Table:
    """Links in one list or pair of blocks: rows (node, null, links), forest rows (a, b, 0) and unsettled pairs (a, b, -1)."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    n = group.num_rows
    if n < 2:
        return none
    key, one, two = group["list"][0].as_py(), group["one"][0].as_py(), group["two"][0].as_py()
    node, weight, block = (group[c].to_numpy() for c in ("node", "weight", "block"))
    unit = np.frombuffer(b"".join(group["code"].to_pylist()), "<i2").reshape(n, -1).astype(np.float32) / np.float32(FULL)
    near = group["near"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    # Two copies are off by half a step a component, and the products by single precision.
    off = math.sqrt(unit.shape[1]) / (2 * FULL)
    hair = 2.1 * off + unit.shape[1] * 2.0**-22
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    counts, forest, open_ = np.zeros(n, np.int64), Forest(n), []
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        near_enough = unit[rows] @ unit[right].T
        i, j = np.nonzero(near_enough >= cosine - hair)
        settled = near_enough[i, j] >= cosine + hair
        i, j = rows[i], right[j]
        if one == two:
            keep = i < j
            i, j, settled = i[keep], j[keep], settled[keep]
        # Candidacy is asked after the cosine, as fewer pairs pass that; a pair must pass both. Some pairs at a time, as
        # the shared pivots of each are counted.
        for s in range(0, len(i), 100_000):
            a, b, sure = (x[s : s + 100_000] for x in (i, j, settled))
            both = near[a][:, :, None] == near[b][:, None, :]
            least = np.where(both[:, :filed, :filed].any(2), near[a][:, :filed], np.iinfo(np.int32).max).min(1)
            own = (least == key) & (both.any(2).sum(1) >= min(shared, near.shape[1]))
            a, b, sure = a[own], b[own], sure[own]
            open_.append((a[~sure], b[~sure]))
            a, b = a[sure], b[sure]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            forest.link(a, b)
    got = np.flatnonzero(counts)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    x, y = (np.concatenate([o[k] for o in open_] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.table({
        "a": pa.array(np.r_[node[got], node[links[:, 0]], node[x]]), "b": pa.concat_arrays([pa.nulls(len(got), pa.int64()), pa.array(np.r_[node[links[:, 1]], node[y]])]),
        "links": pa.array(np.r_[counts[got], np.zeros(len(links), np.int64), np.full(len(x), -1)]),
    })


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def listed(nodes: DataFrame, pivots: dict[int, np.ndarray], filed: int = FILED, block: int = BLOCK) -> DataFrame:
    """Rows (list, one, two, block, node, weight, near, code): each list, and each pair of blocks of a long one, is a (list, one, two)."""
    described = stored(nodes.select("node", "weight", "embedding").mapInArrow(lambda it: _describe(it, pivots), "node long, weight long, near array<int>, code binary"))
    posted = described.select(F.explode(F.slice("near", 1, filed)).alias("list"), "node", "weight", "near", "code")
    # As many rows as there are pivots (and rare widths) at most, of which the long ones stay.
    long = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = posted.join(F.broadcast(long), "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("list", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "weight", "near", "code")


def _settled(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """Those of pairs (a, b) that are at a cosine of `cosine` or more in double precision, with both weights."""

    @arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = (unit_rows(np.asarray(z.values.to_numpy(zero_copy_only=False))[None, :])[0] for z in (p, q))
            out.append(bool(u @ v >= cosine))
        return pa.array(out, pa.bool_())

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("weight").alias(f"w{c}"), F.col("embedding").alias(f"e{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(linked("ea", "eb")).select("a", "b", "wa", "wb")


def embedding_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = COSINE, root: float = PIVOT_ROOT, filed: int = FILED, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: (id, n_links, component_id, kept).

    n_links counts the other rows at a cosine of `cosine` or more that the index retrieves (recall is measured in the
    tests; a pair is never linked below it). Vectors that are null, empty, zero, or hold a null or non-finite component
    have no link and are their own component; vectors of different widths are never linked. Rows that repeat an id, or
    have none, are rows of their own and link like others; component_id is the least id of the class that is not null.
    An empty table has no rows. Vectors count as equal by two 64-bit hashes. Other columns are not looked at.
    """
    vector = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    # The second hash has another seed; equal vectors agree in both.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("embedding")).withColumn("good", _usable(F.col("embedding")))
    good = rows.where("good").select("id", "embedding", F.xxhash64("embedding").alias("k"), F.xxhash64(F.lit(7), F.col("embedding")).alias("k2"))
    one = good.groupBy("k", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    nodes = stored(one.withColumn("node", F.monotonically_increasing_id()))
    met = listed(nodes, choose_pivots(nodes, root), filed, block)
    keys = ["list", "one", "two"]
    sorted_ = met.repartition(*keys).sortWithinPartitions(*keys)
    found = stored(sorted_.mapInArrow(lambda it: (b for t in runs(it, keys) for b in _verify(t, cosine, filed, shared).to_batches()), "a long, b long, links long"))
    exact = stored(_settled(found.where("links = -1").select("a", "b"), nodes, cosine))
    parts = [found.where("links > 0").select("a", "links"), exact.select("a", F.col("wb").alias("links")), exact.select(F.col("b").alias("a"), F.col("wa").alias("links"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    edges = found.where("links = 0").select("a", "b").unionByName(exact.select("a", "b"))
    classes = components(nodes.select(F.col("node").alias("id")), edges).select(F.col("id").alias("node"), F.col("component_id").alias("class"))
    known = nodes.select("k", "k2", "node", "least", "weight").join(classes, "node").join(counts, "node", "left")
    known = known.select("k", "k2", "class", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")).checkpoint()
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    known = lookup(known, ["class"], least, F.xxhash64("k")).select("k", "k2", "n_links", "component_id")
    linked = lookup(good.select("id", "k", "k2"), ["k", "k2"], known, F.xxhash64("id")).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings whatever their labels."""
    return embedding_classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
