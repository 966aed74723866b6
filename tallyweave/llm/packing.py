"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most LENGTH tokens. The histogram of piece lengths (LENGTH bins at most) goes to
the driver, and lengths are placed longest first: all pieces of one length at once, into the pack patterns with the
most room left first, or into new patterns. A pattern is the list of lengths in a pack and a count of such packs.
Patterns then join back to the pieces by rank: the pieces of one length are numbered from 0, and each pattern slot of
that length owns a range of numbers. See Krell et al., "Efficient Sequence Packing without Cross-contamination".

What reaches the driver depends on LENGTH alone: the histogram, and the patterns made of it.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless, scratch, stored, table, text_of
from .tokens import tokenizer_path, word_encoder

LENGTH = 2048
END_ID = 1
#: Pieces of one length in a part when they are numbered.
PART_PIECES = 100_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placing, number of packs) that hold histogram[n] pieces of each length n.

    Among open patterns the one with the most room comes first; ties go to the older one.
    """
    full: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[list]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    for n in sorted((k for k, v in histogram.items() if v), reverse=True):
        if not 0 < n <= length:
            raise ValueError(f"a piece of {n} tokens does not fit {length}")
        left, placed = histogram[n], []
        while left and rooms and rooms[-1] >= n:
            room = rooms[-1]
            pattern, count = open_[room][0]
            used = min(left, count)
            left -= used
            if used == count:
                open_[room].pop(0)
                if not open_[room]:
                    rooms.pop()
            else:
                open_[room][0][1] -= used
            placed.append((room - n, (*pattern, n), used))
            # The pack just filled may still have the most room, so it is open to the next pieces at once.
            _open(placed.pop(), open_, rooms, full)
        if left:
            per = length // n
            for used, k in ((left // per, per), (1 if left % per else 0, left % per)):
                if used and k:
                    _open((length - n * k, (n,) * k, used), open_, rooms, full)
    return full + [(tuple(p), c) for room in sorted(open_) for p, c in open_[room] if c]


def _open(pack: tuple[int, tuple[int, ...], int], open_: dict, rooms: list[int], full: list) -> None:
    room, pattern, count = pack
    if not room:
        full.append((pattern, count))
        return
    if not open_[room]:
        insort(rooms, room)
    open_[room].append([pattern, count])


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank each slot's range starts, its first sequence, and its offset in the sequence."""
    first, taken, ranges = 0, Counter(), defaultdict(list)
    for pattern, count in patterns:
        at = 0
        for n in pattern:
            ranges[n].append((taken[n], first, at))
            taken[n] += count
            at += n
        first += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in ranges.items()}


def pack(pieces: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """pieces (length long, and columns that tell them apart) with sequence_id and offset (long).

    Each piece lies in one sequence; offsets in a sequence are gapless from 0; pieces without tokens are left out.
    Repeated rows are pieces of their own, an empty table has none, and columns named sequence_id or offset are
    replaced. pieces is read twice, so it should be a stored table.
    """
    pieces = pieces.where("length > 0").drop("sequence_id", "offset")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = slots(shortest_pack_first(histogram, length))
    names = [c for c in pieces.columns]
    rank = scratch("rank")
    # The commonest length, of which whole sequences are, is numbered in as many parts as it needs.
    salts = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-max(histogram.values(), default=0) // part_pieces))
    ranked = gapless(pieces, ["length"], F.xxhash64(*names), [F.col(f"`{c}`") for c in names], rank, salts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", rank))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for k in np.unique(n):
                rows = np.flatnonzero(n == k)
                starts, first, at = where[int(k)]
                slot = np.searchsorted(starts, number[rows], "right") - 1
                sequence[rows], offset[rows] = first[slot] + number[rows] - starts[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def cut(ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and what is left."""
    return [(at, min(length, len(ids) - at)) for at in range(0, len(ids), length)]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids: little-endian 32-bit).

    A text's ids are the tokenizer's without special tokens, then END_ID; a null text is empty and so has END_ID alone.
    Repeated rows have pieces each, a null doc_id stays null, and other columns of docs are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder.encode_all(part["text"].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for start, n in cut(ids, length):
                        raw = ids[start : start + n].tobytes()
                        out.append((doc, start, n, zlib.crc32(raw), len(ids), raw)[: 6 if with_ids else 5])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=False)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(encode, PIECE + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    return pack(stored(token_pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), length)), length)


def op1_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
