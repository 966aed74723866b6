"""Byte-level BPE encoding and decoding through a table of distinct words.

1. Texts are split into words, each with the white space before it, block of documents by block. A block keeps its
   distinct words once, and for every document the words' numbers in order.
2. The blocks' words are shuffled by word, so that one task holds all that is the same; it encodes each distinct word
   once and sends the ids back to the blocks that asked.
3. Blocks meet the ids of their words, and documents are put together by position.

Words that many documents have would reach one task from every block. They are encoded before all else, FREQUENT of
them at most, and their ids go with the code of steps 1 and 3; which words these are rests on a bounded sample of the
documents, changes the cost, and never the result.

Decoding joins ids to the table of pieces by id, a batch of documents at a time. The table's size is fixed by the
vocabulary file, and an id is its row number, so the join is one gather of Arrow arrays; put as a DataFrame join it
would shuffle every token of the corpus to bring a document's pieces together again.

Steps 1 and 3 each read the texts, which is less than to keep the blocks meanwhile. Both must see the rows in the same
order, so only what comes straight from files is read twice, and anything else is stored first. A block is named by a
hash of its content, and one that step 1 did not see stops the run instead of giving wrong ids.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, stored, table, text_of
from .tokens import ODD, load, tokenizer_path

#: Python's white space is Unicode's but for ODD, whose texts go whole.
SPACED_WORD = re.compile(r"\s*\S+|\s+")
#: Characters of text in a block, and bytes of text for each part of the word shuffle.
BLOCK_CHARS, PART_BYTES = 1 << 22, 1 << 24
#: Words after which a block's documents go on in a further row.
PIECE_WORDS = 1 << 14
#: Words encoded ahead at most, their characters at most, and the documents (about) that are looked at to choose them.
FREQUENT, FREQUENT_CHARS, FREQUENT_DOCS = 1 << 16, 64, 20_000
#: Stands for a null doc_id inside a block.
NO_ID = -(1 << 63)


def words_of(text: str) -> list[str]:
    """A text as words with the white space before them; their chain is the text."""
    return [text] if ODD.search(text) else SPACED_WORD.findall(text)


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id's piece. The vocabulary writes byte b as the b-th printable character, or as 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = load(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


class Pieces:
    """A table of bytes by id, and the join of documents' ids to it."""

    def __init__(self, pieces: list[bytes]):
        #: One more row, of no bytes, for ids that the table lacks.
        self.rows = pa.array([*pieces, b""], pa.large_binary())

    def joined(self, flat: np.ndarray, cuts: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids flat[cuts[k]:cuts[k + 1]] for each k; ids that the table lacks have none."""
        none = len(self.rows) - 1
        at = np.where((flat < 0) | (flat >= none), none, flat.astype(np.int64))
        met = self.rows.take(pa.array(at))
        ends = np.frombuffer(met.buffers()[1], np.int64, len(met) + 1, met.offset * 8)[cuts].tolist()
        raw = memoryview(met.buffers()[2] or b"")
        return (bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False))


def text_of_bytes(raw: bytes) -> str:
    """The text of bytes; those that are not UTF-8 become U+FFFD."""
    return raw.decode("utf-8", "replace")


def decode(ids: np.ndarray, pieces: list[bytes]) -> str:
    """The text of one document's ids."""
    return text_of_bytes(next(Pieces(pieces).joined(np.asarray(ids), np.array([0, len(ids)]))))


ROW = "block long, kind int, seq int, n long, a binary, b binary, c binary"


def row(*values) -> pa.RecordBatch:
    """One row of ROW. Kind 0: the ids of n words (a: their numbers, b: sizes and ids); kind 1: documents (a: ids, b: lengths, c: words)."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["block", "kind", "seq", "n", "a", "b", "c"])


def _pressed(*parts: np.ndarray) -> bytes:
    """Numbers as planes of equal-valued bytes, which press better than the numbers do."""
    return zstandard.ZstdCompressor(3).compress(b"".join(p.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts))


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, ahead: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """ROW pieces of each block; or, with parts, (part, block, n, at, words): a block's words dealt to parts.

    ahead: the words encoded ahead by number; they have these numbers in every block and are not dealt.
    """
    docs, lengths, words, chars, name = [], [], [], 0, xxhash.xxh3_64()

    def block() -> Iterator[pa.RecordBatch]:
        names = [w for w in dict.fromkeys(words) if w not in ahead]
        number = ahead | dict(zip(names, range(len(ahead), len(ahead) + len(names)), strict=True))
        raw = np.fromiter(map(number.__getitem__, words), "<u4", len(words))
        # The block's own words get numbers by how often it has them.
        order = np.argsort(-np.bincount(raw, minlength=len(number))[len(ahead) :], kind="stable")
        key = name.intdigest() - (1 << 63)
        if parts:
            coded = [names[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
            part = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % parts
            at = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, part[at][1:] != part[at][:-1], True]) if len(at) else np.array([0])
            rows = []
            for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                mine = at[s:e]
                some = [coded[i] for i in mine.tolist()]
                gaps = np.diff(mine, prepend=0)
                rows.append((int(part[mine[0]]), key, len(mine), _pressed(gaps), zstandard.ZstdCompressor(3).compress(_pressed_words(some))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "n", "at", "words"])
            return
        place = np.arange(len(number), dtype="<u4")
        place[len(ahead) + order] = np.arange(len(ahead), len(number))
        ids, sizes, ends, codes = np.array(docs, "<i8"), np.array(lengths, "<u4"), np.cumsum([0, *lengths]), place[raw]
        cut = [0, *(np.flatnonzero(np.diff(ends[1:-1] // PIECE_WORDS)) + 1).tolist(), len(docs)]
        for s, e in zip(cut, cut[1:], strict=False):
            yield row(key, 1, s, 0, ids[s:e].tobytes(), sizes[s:e].tobytes(), _pressed(codes[ends[s] : ends[e]]))

    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if chars and chars + len(text) > BLOCK_CHARS:
                yield from block()
                docs, lengths, words, chars, name = [], [], [], 0, xxhash.xxh3_64()
            own = words_of(text)
            docs.append(NO_ID if doc is None else doc)
            lengths.append(len(own))
            words += own
            chars += len(text)
            name.update(b"%d:" % len(text) + text.encode("utf-8", "surrogatepass"))
    if docs:
        yield from block()


def _pressed_words(words: list[bytes]) -> bytes:
    return np.fromiter(map(len, words), "<u4", len(words)).view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(words)


def _words(raw: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(_unplane(raw[: 4 * n]), dtype=np.int64).tolist()
    text = raw[4 * n :]
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """A row of kind 0 for every row of a part, each distinct word of the part encoded once."""
    tokenizer, press = load(path), zstandard.ZstdDecompressor()
    for part in runs(batches, ["part"]):
        rows = [_words(press.decompress(w), n) for w, n in zip(part["words"].to_pylist(), part["n"].to_pylist(), strict=True)]
        known: dict[bytes, np.ndarray] = dict.fromkeys(w for r in rows for w in r)
        names = list(known)
        for s in range(0, len(names), 4096):
            some = names[s : s + 4096]
            found = tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)
            known.update((w, e.ids) for w, e in zip(some, found, strict=True))
        for block, at, words in zip(part["block"].to_pylist(), part["at"].to_pylist(), rows, strict=True):
            mine = list(map(known.__getitem__, words))
            sizes = np.fromiter(map(len, mine), "<u4", len(mine))
            ids = np.fromiter(chain.from_iterable(mine), "<u4", int(sizes.sum()))
            yield row(block, 0, 0, len(mine), at, _pressed(sizes, ids), None)


def _unplane(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _assemble(batches: Iterator[pa.RecordBatch], finish: Callable, ahead: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Documents of rows that come sorted by block and kind: word numbers become ids by position. ahead: ids of the first numbers."""
    press, current, found, ready = zstandard.ZstdDecompressor(), None, [], None
    some = np.fromiter(map(len, ahead), np.int64, len(ahead))
    flat0 = np.concatenate([*ahead, np.empty(0, "<u4")]).astype("<u4")
    for batch in batches:
        for block, kind, n, a, b, c in zip(*(batch[x].to_pylist() for x in ("block", "kind", "n", "a", "b", "c")), strict=True):
            if block != current:
                current, found, ready = block, [], None
            if kind == 0:
                raw = press.decompress(b)
                found.append((len(some) + np.cumsum(_unplane(press.decompress(a)), dtype=np.int64), _unplane(raw[: 4 * n]), _unplane(raw[4 * n :])))
                continue
            if ready is None:
                size = np.r_[some, np.zeros(sum(len(f[0]) for f in found), np.int64)]
                first = np.r_[np.cumsum(some) - some, np.zeros(len(size) - len(some), np.int64)]
                base = len(flat0)
                for places, sizes, flat in found:
                    size[places] = sizes
                    first[places] = base + np.cumsum(sizes, dtype=np.int64) - sizes
                    base += len(flat)
                ready, found = (size, first, np.concatenate([flat0, *(f[2] for f in found)])), []
            size, first, ids = ready
            docs, lengths, codes = np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4").astype(np.int64), _unplane(press.decompress(c))
            if len(codes) and codes.max() >= len(size):
                raise RuntimeError("the texts were not the same when they were read again")
            each = size[codes]
            ends = np.r_[0, np.cumsum(each)]
            out = ids[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
            yield finish(pa.array(docs, mask=docs == NO_ID), out, ends[np.r_[0, np.cumsum(lengths)]])


def words_ahead(rows: DataFrame, n: int, most: int = FREQUENT) -> list[str]:
    """The words that most documents have, in a sample of about FREQUENT_DOCS of n, chosen by a hash of the id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(chain.from_iterable(set(words_of(t)) for t in batch["text"].to_pylist()))
            kept = [(w, k) for w, k in seen.items() if len(w) <= FREQUENT_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w, _ in kept], pa.binary()), pa.array([k for _, k in kept], pa.int64())], ["word", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // FREQUENT_DOCS))) == 0)
    found = sample.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return [w.decode("utf-8", "surrogatepass") for w in found["word"].to_pylist()]


def _steady(df: DataFrame) -> bool:
    """Whether df comes straight from files or given rows, so that it has the same rows in the same order each time it is read."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return all(re.match(r"[\s+:|-]*(Project|Filter|Relation|LocalRelation)\b", x) for x in plan if x.strip())


def encode_documents(docs: DataFrame, tokenizer: str, finish: Callable, schema: str) -> DataFrame:
    """What finish makes of (doc ids, all ids, where each text's begin and the last one's end) for every row of docs (doc_id long, text).

    Null texts are empty and have no ids; a null doc_id stays null; repeated rows are encoded each; an empty table has
    no rows, and other columns are not looked at. The result is stored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if not _steady(rows):
        rows = stored(rows)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // PART_BYTES))
    words = words_ahead(rows, size["n"])
    ahead = {w: i for i, w in enumerate(words)}
    ids = [np.array(e.ids, "<u4") for e in load(tokenizer).encode_batch_fast(words, add_special_tokens=False)] if words else []
    dealt = rows.mapInArrow(lambda it: _blocks(it, parts, ahead), "part long, block long, n long, at binary, words binary")
    blocks = rows.mapInArrow(lambda it: _blocks(it, 0, ahead), ROW)
    packs = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda it: _encode(it, tokenizer), ROW)
    met = blocks.unionByName(packs).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return stored(met.mapInArrow(lambda it: _assemble(it, finish, ids), schema))


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""

    def finish(ids: pa.Array, flat: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])

    return encode_documents(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), finish, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are an empty text, and ids that the vocabulary lacks are left out."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(piece_bytes(path))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part["ids"]
                sizes = np.array([0 if k is None else k for k in pc.list_value_length(ids).to_pylist()], np.int64)
                flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(text_of_bytes, pieces.joined(flat, np.r_[0, np.cumsum(sizes)])), pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(texts, "doc_id long, text string")


def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of all documents."""
    path = tokenizer_path("byte_bpe_50k.json")
    tables: dict[str, Pieces] = {}

    def finish(ids: pa.Array, flat: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        if not tables:
            pieces = piece_bytes(path)
            tables["pieces"], tables["decimal"] = Pieces(pieces), Pieces([b"%d," % i for i in range(len(pieces))])
        said = [hashlib.sha256(x[:-1]).hexdigest() for x in tables["decimal"].joined(flat, cuts)]
        back = [hashlib.sha256(text_of_bytes(x).encode()).hexdigest() for x in tables["pieces"].joined(flat, cuts)]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cuts)), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(table(spark, sf_dir, "documents"), path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
