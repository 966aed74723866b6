"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct 64-bit fingerprints are sorted by Gray rank, so that neighbours share long runs of equal bits. Every 16 of
them make a node that holds what they have in common (their shared bits, without those that the node above already
shares), every 16 nodes a node above, up to a root. A search goes down from the root and adds, node by node, how many
of the newly shared bits the query lacks; as soon as the sum exceeds the allowed distance, the whole group below is
dropped.

The index is spread by its topmost pattern: two fingerprints at most MAX_BITS apart agree wholly in one of
MAX_BITS + 1 bands, so each fingerprint is filed once a band, under the band's bits turned to the top. Those bits
head the Gray order, and the index of one top pattern is searched by one task. A pattern that very many fingerprints
have is parted again by the bands of its remaining bits, by the same argument and as often as it takes, so that an
index stays small and nothing is lost by parting.

Only a spanning forest of the links leaves a task (links inside a class are implied), and classes are joined by
contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import components, lookup, scratch, shared_dir, stored, table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints under one top pattern above which its index is parted by further bands.
WIDE = 4096
FANOUT = 16


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from bit 0."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """The SimHash of a text (null: empty) as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    count = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(_xxh, grams), np.uint64, count)
    return int(np.packbits(_bit_sums(hashes) * 2 > count, bitorder="little").view("<u8")[0])


def _xxh(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram, SEED)


def simhash(text: Column) -> Column:
    """Fingerprint of a text column as a long with the same 64 bits."""

    @arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return prints(text.cast("string"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The tree over fingerprints sorted by Gray rank: per level, the values and the mask of the bits that a node shares and the one above does not."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.visited = prints, 0
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        ones = zeros = prints  # bits set in all below, in any below
        while len(ones) > 1 or not whole:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(zeros, at)
            whole.append((ones, ~(ones ^ zeros)))
        self.levels = [(bits, mask & ~np.repeat(up, FANOUT)[: len(mask)]) for (bits, mask), (_, up) in zip(whole, whole[1:], strict=False)] + whole[-1:]
        #: What the lowest nodes leave open of each fingerprint.
        self.rest = ~np.repeat(whole[0][1], FANOUT)[: len(prints)]

    def pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j, of all pairs at most max_bits apart, some at a time. `visited` counts the nodes and prints looked at."""
        n = len(self.prints)
        for at in range(0, n, 2048):
            query = np.arange(at, min(n, at + 2048))
            node, apart = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                bits, mask = self.levels[depth]
                self.visited += len(query)
                apart = apart + np.bitwise_count((self.prints[query] ^ bits[node]) & mask[node])
                keep = apart <= max_bits
                query, node, apart = query[keep], node[keep], apart[keep]
                below = len(self.levels[depth - 1][0]) if depth else n
                query, apart, node = np.repeat(query, FANOUT), np.repeat(apart, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                keep = node < below
                # Nodes that end before the query hold only pairs that were found from the other side.
                keep &= (node + 1) * FANOUT**depth > query
                query, node, apart = query[keep], node[keep], apart[keep]
            self.visited += len(query)
            apart = apart + np.bitwise_count((self.prints[query] ^ self.prints[node]) & self.rest[node])
            keep = (node > query) & (apart <= max_bits)
            yield query[keep], node[keep]


class Forest:
    """Union-find over 0..n-1 that keeps the links by which two sets met."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.links.append((x, y))


def _search(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest (a, b) of the links among rows (pattern, turned, node) that come sorted by pattern."""

    def solve(node: np.ndarray, turned: np.ndarray) -> pa.RecordBatch | None:
        order = np.argsort(gray_rank(turned), kind="stable")
        node, index, forest = node[order], GrayIndex(turned[order]), Forest(len(order))
        for i, j in index.pairs(max_bits):
            forest.link(i, j)
        if not forest.links:
            return None
        at = np.array(forest.links)
        return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch["pattern"].to_numpy(zero_copy_only=False), batch["node"].to_numpy(zero_copy_only=False), batch["turned"].to_numpy(zero_copy_only=False).view(np.uint64)))
        p, n, t = (np.concatenate(x) for x in zip(*held, strict=True))
        # Patterns that have ended are searched together: they differ in the top bits, where the index parts them.
        ended = np.flatnonzero(p != p[-1])
        done = int(ended[-1]) + 1 if len(ended) else 0
        if done >= 8192:
            if (out := _by_pattern(p[:done], n[:done], t[:done], solve)) is not None:
                yield from out
            p, n, t = p[done:], n[done:], t[done:]
        held = [(p, n, t)]
    if held:
        p, n, t = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from _by_pattern(p, n, t, solve)


def _by_pattern(p: np.ndarray, n: np.ndarray, t: np.ndarray, solve) -> list[pa.RecordBatch]:
    """Rows of one pattern are never compared with those of another: lone ones go, the rest share one index."""
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    sizes = np.diff(np.r_[starts, len(p)])
    out = []
    large = np.repeat(sizes > 64, sizes)
    for s, k in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        out.append(solve(n[s : s + k], t[s : s + k]))
    small = np.repeat(sizes > 1, sizes) & ~large
    if small.any():
        out.append(solve(n[small], t[small]))
    return [x for x in out if x is not None]


def _refiled(filed: DataFrame, n: int) -> DataFrame:
    """Each row (node, turned, used, pattern) once for each of n bands of the bits below its `used` top ones, with the band turned up to them."""
    rest = "(64 - used)"
    bands_ = ", ".join(f"struct({k} AS k, cast({rest} * {k} / {n} AS int) AS low, cast({rest} * {k + 1} / {n} AS int) AS high)" for k in range(n))
    each = filed.select("node", "turned", "used", "pattern", F.expr(f"explode(array({bands_})) AS b"))
    # The low part without the top bits (a shift by 64 would be one by 0), and the same turned so that the band comes first.
    top = "CASE WHEN used = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(turned, 64 - used), 64 - used) END"
    tail = "(turned ^ top)"
    up = f"CASE WHEN b.high = {rest} THEN {tail} ELSE shiftrightunsigned({tail}, b.high) | shiftrightunsigned(shiftleft({tail}, 64 - b.high), used) END"
    turned = each.withColumn("top", F.expr(top)).select("node", F.expr(f"top | ({up}) AS turned"), F.expr("used + b.high - b.low AS used"), "pattern", "b.k")
    return turned.select("node", "turned", "used", F.xxhash64("pattern", "k", F.expr("shiftrightunsigned(turned, 64 - used)")).alias("pattern"))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, wide: int | None = None) -> DataFrame:
    """Links (a, b) between node ids that span the classes of fingerprints at most max_bits apart.

    nodes: (fp long, node long), distinct in fp, and better stored: it is read twice, and once more for each further
    parting of patterns with over `wide` fingerprints (WIDE, unless given).
    """
    wide, n = WIDE if wide is None else wide, max_bits + 1
    shared_dir(nodes.sparkSession)
    filed = _refiled(nodes.select("node", F.col("fp").alias("turned"), F.lit(0).alias("used"), F.lit(0).cast("long").alias("pattern")), n)
    small = None
    while True:
        # A pattern whose remaining bits allow no more than `wide` values has no more fingerprints, as they are distinct.
        crowded = filed.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.max("used").alias("used")).where(F.col("count") > wide).where(F.col("used") <= 64 - n)
        crowded = crowded.select("pattern", F.lit(True).alias("crowded")).checkpoint()
        if crowded.isEmpty():
            small = filed if small is None else small.unionByName(filed)
            break
        marked = lookup(filed, ["pattern"], crowded, F.xxhash64("node")).checkpoint()
        few = marked.where("crowded IS NULL").drop("crowded")
        small = few if small is None else small.unionByName(few)
        filed = _refiled(marked.where("crowded").drop("crowded"), n)
    sorted_ = small.select("node", "turned", "pattern").repartition("pattern").sortWithinPartitions("pattern")
    return sorted_.mapInArrow(lambda it: _search(it, max_bits), "a long, b long")


def _classes(prints: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """(fp, first): for each fingerprint of prints the least `first` in its class."""
    shared_dir(prints.sparkSession)
    nodes = prints.groupBy("fp").agg(F.min(first).alias("own")).checkpoint()
    found = components(nodes.select(F.col("fp").alias("id")), links(nodes.select("fp", F.col("fp").alias("node")), max_bits))
    per = nodes.join(found, nodes["fp"] == found["id"]).select("fp", "own", "component_id").checkpoint()
    least = per.groupBy("component_id").agg(F.min("own").alias("first"))
    return lookup(per, ["component_id"], least, F.xxhash64("fp")).select("fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of docs: (id, fp, component_id): fingerprint, and the smallest id that links of at most max_bits reach.

    Texts without words have fingerprint 0 and link like others; so do null texts. Equal fingerprints are one vertex
    and are never paired. A null id is never a component's; where a class has no other, component_id is null.
    Repeated rows stay, and rows with one id and several texts have a row and a class for each.
    """
    prints = stored(docs.select(F.col(id_col).cast("long").alias("id"), simhash(F.col(text_col)).alias("fp")))
    return lookup(prints, ["fp"], _classes(prints, F.col("id"), max_bits), F.xxhash64("id")).select("id", "fp", F.col("first").alias("component_id"))


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every whole text of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class of docs, with its columns: the one of the smallest doc_id (null last), then text hash.

    Of rows equal in doc_id and text one stays.
    """
    h, number, own_id, own_h = (scratch(x) for x in ("hash", "number", "id", "own"))
    marked = docs.withColumn(h, F.xxhash64(F.col("text")))
    prints = stored(marked.select(F.col("doc_id").cast("long").alias("id"), F.col(h).alias("h"), simhash(F.col("text")).alias("fp")))
    kept = _classes(prints, F.struct(F.col("id").isNull().alias("last"), "id", "h"), max_bits).select(F.col("first.id").alias(own_id), F.col("first.h").alias(own_h)).distinct()
    one = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_h)), "left_semi")
    order = Window.partitionBy("doc_id", h).orderBy(F.lit(1))
    return one.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
