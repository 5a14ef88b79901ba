"""Packing documents into sequences by lexical retrieval.

1. Every document is encoded, followed by id 0. Full sequences are cut from its start; what is left is a tail.
2. Document frequencies of token ids are counted over all pieces. Their number is bounded by the vocabulary.
3. Tails are dealt out by range over min-hashes of their ids, so that similar tails meet and a hot key is spread.
   Each partition is read in blocks; a block is a shard with its own inverted index and BM25 weights.
4. A seed's BM25 neighbours in the shard fill its sequence: first those that fit, then the best one is cut and the rest
   of it stays available. What a shard leaves open goes on into the next one of the partition.
5. The last open sequence of a partition is cut into lengths that are powers of two, which need no padding.

Null texts are empty and give the single id 0. Rows that repeat are packed as often as they come. Ids are stored in 16
bits between the steps; the vocabulary must have at most 65,536 ids. Equal scores go to the tail that comes first. An empty table
gives an empty table; only doc_id and text are read, whatever other columns are called.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import schema
from assetweave.llm.tokens import encoder
from assetweave.session import cut_lineage

LENGTH = 1024
SHARD = 512  # tails per inverted index
TAILS = 8192  # tails per task
K1, B = 1.2, 0.75
IDS = 1 << 16


def _permutations() -> np.ndarray:
    made = np.random.default_rng(5)
    return np.stack([made.permutation(IDS) for _ in range(3)]).astype(np.int32)


def _cut(path: str, length: int):
    """Rows of text to rows of pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode, mixed = encoder(path).encode_all, _permutations()
        number = TaskContext.get().partitionId() << 34
        for batch in batches:
            at, total, start, size, ids, sequence, keys = ([] for _ in range(7))
            waiting = 0

            def flush():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(total, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()),
                     *[pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]],
                    ["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "k0", "k1", "k2"])
            for i, found in enumerate(encode(batch.column(1))):
                found = np.append(found, np.uint16(0))
                for begin in range(0, len(found), length):
                    piece = found[begin:begin + length]
                    full = len(piece) == length
                    at.append(i), total.append(len(found)), start.append(begin), size.append(len(piece))
                    ids.append(piece.tobytes())
                    sequence.append(number if full else None)
                    keys.append((None, None, None) if full else tuple(mixed[:, piece].min(axis=1).tolist()))
                    number += 2 * full
                waiting += len(found)
                if waiting > 2_000_000:
                    yield flush()
                    waiting = 0
                    for x in (at, total, start, size, ids, sequence, keys):
                        x.clear()
            if at:
                yield flush()
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of pieces that hold each id, of one task."""
    counts, seen = np.zeros(IDS, np.int64), np.zeros(IDS, np.uint8)
    few, rows = np.zeros(IDS, np.uint8), 0
    for batch in batches:
        for piece in batch.column(0):
            ids = np.frombuffer(piece.as_buffer(), np.uint16)
            seen[ids] = 1
            few += seen
            seen[ids] = 0
            rows += 1
            if rows % 255 == 0:
                counts += few
                few[:] = 0
    counts += few
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["id", "n"])


class _Shard:
    """Inverted index over the tails of a block. Ids in more than half of all pieces weigh nothing and have no postings."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        n = self.n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.concatenate(pieces).astype(np.int64)
        keys = ids * n + np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(keys[idf[ids] > 0], return_counts=True)
        self.doc, ids = pairs % n, pairs // n
        self.weight = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        self.begin = first
        self.size = np.diff(np.append(first, len(ids)))
        term = np.repeat(np.arange(len(first)), self.size)
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = np.split(term[by_doc], np.cumsum(np.bincount(self.doc, minlength=n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed]
        if not len(terms):
            return np.zeros(self.n)
        sizes = self.size[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[terms] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def _pack(idf: np.ndarray, mean: float, length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = (TaskContext.get().partitionId() << 34) + 1
        doc_type = None

        def emit(windows):
            """Windows are lists of (doc_id, doc_tokens, start, ids)."""
            nonlocal number
            rows = []
            for w in windows:
                offset = 0
                for doc, total, start, ids in w:
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                    offset += len(ids)
                number += 2
            kinds = (doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        items: list[tuple] = []
        held = 0  # ids; fewer than a sequence fill none, however many texts they are
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, total, start, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                items.append((doc, total, start, np.frombuffer(ids, np.uint16)))
                held += len(items[-1][3])
                if len(items) >= block and held >= length:
                    full, items = _fill(items, idf, mean, length)
                    held = sum(len(x[3]) for x in items)
                    yield emit(full)
        if held >= length:
            full, items = _fill(items, idf, mean, length)
            yield emit(full)
        if items:
            yield emit(_powers(items))
    return run


def _fill(items: list[tuple], idf: np.ndarray, mean: float, length: int) -> tuple[list[list], list[tuple]]:
    """Full windows from a block, and the pieces of the window that stayed open."""
    shard = _Shard([x[3] for x in items], idf, mean)
    left = np.array([len(x[3]) for x in items])
    begun = np.zeros(len(items), np.int64)
    seeds, windows, total = iter(np.argsort(-left, kind="stable").tolist()), [], int(left.sum())

    def take(i: int, n: int) -> tuple:
        doc, tokens, start, ids = items[i]
        at = int(begun[i])
        begun[i] += n
        left[i] -= n
        return doc, tokens, start + at, ids[at:at + n]
    while total >= length:
        seed = next(seeds)
        while left[seed] > 0 and total >= length:
            window, room = [take(seed, int(min(left[seed], length)))], length
            room -= len(window[0][3])
            scores = shard.scores(seed) if room else None
            while room:
                fits = np.where((left > 0) & (left <= room), scores, -1.0)
                best = int(fits.argmax())
                if fits[best] < 0:
                    best = int(np.where(left > 0, scores, -1.0).argmax())
                window.append(take(best, int(min(left[best], room))))
                room -= len(window[-1][3])
            total -= length
            windows.append(window)
    return windows, [take(i, int(left[i])) for i in np.flatnonzero(left > 0)]


def _powers(items: list[tuple]) -> list[list]:
    """The last pieces in sequences whose lengths are powers of two."""
    windows, queue = [], list(items)
    open_tokens = sum(len(x[3]) for x in queue)
    while open_tokens:
        room = 1 << (open_tokens.bit_length() - 1)
        open_tokens -= room
        window = []
        while room:
            doc, tokens, start, ids = queue.pop(0)
            window.append((doc, tokens, start, ids[:room]))
            if len(ids) > room:
                queue.insert(0, (doc, tokens, start + room, ids[room:]))
            room -= len(window[-1][3])
        windows.append(window)
    return windows


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (32 bits each, little-endian), doc_tokens, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = cut_lineage(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, length), schema(
        f"doc_id {doc_type}, doc_tokens long, start long, length long, ids binary, sequence_id long, k0 int, k1 int, k2 int")),
        "pieces")
    counted = pieces.select("ids").mapInArrow(_frequencies, schema("id int, n long")).groupBy("id").agg(F.sum("n").alias("n"))
    held = counted.toArrow()  # one row per id of the vocabulary at most
    size = pieces.agg(F.count("*"), F.sum("length"), F.count("k0")).first()
    n, tails = size[0], size[2]
    df = np.zeros(IDS)
    df[held["id"].to_numpy()] = held["n"].to_numpy()
    idf = np.where(df > 0, np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))), 0)
    mean = (size[1] or 0) / max(n, 1)
    full = pieces.filter("k0 IS NULL")
    full = full.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id").mapInArrow(
        _widen, schema(f"doc_id {doc_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))
    dealt = pieces.filter("k0 IS NOT NULL").select("doc_id", "doc_tokens", "start", "ids", "k0", "k1", "k2").repartitionByRange(
        max(1, -(-tails // TAILS)), "k0", "k1", "k2", F.xxhash64("doc_id", "ids")).sortWithinPartitions(
        "k0", "k1", "k2", F.xxhash64("doc_id", "ids"), "doc_id", "start", "ids")
    packed = dealt.select("doc_id", "doc_tokens", "start", "ids").mapInArrow(
        _pack(idf, mean, length, shard), full.schema)
    return full.unionByName(packed)


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full pieces as sequences of their own, ids from 16 to 32 bits."""
    for batch in batches:
        ids = [np.frombuffer(x.as_buffer(), np.uint16).astype("<u4").tobytes() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), batch.column(4), batch.column(5),
             pa.array(np.zeros(len(ids), np.int64))],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
