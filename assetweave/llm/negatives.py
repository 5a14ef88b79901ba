"""Hard negatives by rotated one-bit codes with intervals, exact in the end.

Components are scaled and floored to integers, a score is an integer inner product. Every vector o is turned by a random
isometry into `bits` numbers, of which the signs are kept: the code. Turned back, the code gives a direction u of length 1, and
two numbers are stored with it: the alignment <o, u> and the length of the rest of o, which is orthogonal to u. For a query q

    <o, q> = <o, u> <u, q> + <rest, q>,    |<rest, q>| <= |rest| sqrt(|q|^2 - <u, q>^2)    (Cauchy and Schwarz)

and <u, q> comes from counting bits: the turned query is cut to a few bit planes, each of which meets the code in AND and
popcount; what the cut changes is bounded by its sum of absolute values. So every pair has an interval that surely holds its score.
The best estimates are scored first, which gives a threshold; every pair whose interval reaches it is scored too. Nothing depends
on luck but the number of pairs to score.

Rows are dealt by id to blocks of a bounded number of rows, anchors go to every block, and a task holds one block and lets the
anchors stream past. Each block returns a few rows per anchor; the best of them are chosen by a window.

Rows take no part whose id or label is null, whose vector is null, or that hold a null or non-finite component. Of rows with one id
the smallest by label, then vector, stands for all. Shorter vectors count as filled up with zeros; empty and zero vectors have score 0
with all. Scores that tie are ordered by id. Without rows or anchors the result is empty. Only id, label and vector are read.
Scaled components and scores have to fit 64 bits; beyond that the job fails and says so.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.session import cut_lineage, task_count

SPREAD = 8  # bits of the code per dimension
PLANES = 5  # bits to which a turned query is cut
BLOCK = 32_768  # rows of a block
LEAST = 2_048  # rows that are worth a block of their own
SEEDS = 4  # times the rows wanted: best estimates that are scored for a threshold
TILE = 1 << 19  # pairs that are looked at together
CODED = ("vec_id long, label long, anchor boolean, block int, code binary, align double, direction double, rest double, norm double, "
         "ints array<long>")


@dataclass(frozen=True)
class Search:
    """`positives` best rows of the label, and for each the `negatives` best rows of other labels with low <= 100 score / positive score <= high."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    seed: int = 13


# --- codes ----------------------------------------------------------------------------------

def _isometry(dims: int, seed: int) -> np.ndarray:
    """(bits, dims) with orthonormal columns."""
    bits = 64 * -(-SPREAD * dims // 64)
    return np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((bits, dims)))[0]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(signs, axis=1).view(np.uint64)


def _coder(dims: int, seed: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = _isometry(dims, seed)
        for batch in batches:
            vectors = _matrix(batch.column("ints"), dims).astype(np.float64)
            norm = np.linalg.norm(vectors, axis=1)
            signs = vectors @ turn.T > 0
            back = (2.0 * signs - 1) @ turn
            direction = np.linalg.norm(back, axis=1)
            align = np.divide((vectors * back).sum(axis=1), direction, out=np.zeros(len(norm)), where=direction > 0)
            rest = np.sqrt(np.maximum(norm**2 - align**2, 0))
            codes = _words(signs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "anchor", "block")), pa.array([x.tobytes() for x in codes], pa.binary()),
                 *map(pa.array, (align, direction, rest, norm)), batch.column("ints")],
                names=["vec_id", "label", "anchor", "block", "code", "align", "direction", "rest", "norm", "ints"])
    return code


def scaled(vectors: DataFrame, anchors: Column, search: Search) -> DataFrame:
    """(vec_id, label, anchor, ints), one row per id, of the rows that take part."""
    number = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(1 << 62)
    fitting = lambda x: F.when(F.abs(x * search.scale) < limit, F.floor(x * search.scale)).otherwise(
        F.raise_error(F.lit("a scaled component doesn't fit 64 bits")).cast("long"))
    taken = vectors.filter(sound).select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                                         F.transform(number, fitting).alias("ints"))
    return taken.groupBy("vec_id").agg(F.min(F.struct("label", "ints", "anchor")).alias("r")).select(
        F.col("vec_id").cast("long").alias("vec_id"), "r.label", "r.anchor", "r.ints")


def coded(vectors: DataFrame, anchors: Column, search: Search = Search()) -> tuple[DataFrame, int, int]:
    """The stored codes (columns of CODED), the number of dimensions and of blocks."""
    rows = cut_lineage(scaled(vectors, anchors, search), "scaled")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    dims = max(dims, 1)
    blocks = max(-(-n // BLOCK), min(task_count(rows.sparkSession), -(-n // LEAST)), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return cut_lineage(dealt.mapInArrow(_coder(dims, search.seed), CODED), "codes"), dims, blocks


# --- intervals --------------------------------------------------------------------------------

def exact_products(rows: np.ndarray, query: np.ndarray, size: float) -> np.ndarray:
    """Integer inner products of rows with a query; `size` is the product of their largest lengths.

    No partial sum exceeds it, so doubles are exact to 2^52 and 64-bit integers to 2^62.
    """
    if rows.dtype == np.float64:
        return (rows @ query.astype(np.float64)).astype(np.int64)
    if size < 2.0**62:
        return rows @ query
    whole = rows.astype(object) @ query.astype(object)
    if any(not -2**63 <= x < 2**63 for x in whole.flat):
        raise ValueError("a score doesn't fit 64 bits")
    return whole.astype(np.int64)


class Block:
    """Rows of one block with their codes."""

    def __init__(self, rows: pa.Table, dims: int):
        label = rows["label"].to_numpy()
        rows = rows.take(pa.array(np.lexsort((rows["vec_id"].to_numpy(), label))))
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(len(self.ids), -1)
        self.align, self.direction, self.rest, self.norm = (rows[c].to_numpy() for c in ("align", "direction", "rest", "norm"))
        self.vectors, self.longest = _matrix(rows["ints"].combine_chunks(), dims), self.norm.max()
        self.doubles = self.vectors.astype(np.float64)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of a query with some rows."""
        size = float(np.linalg.norm(query.astype(np.float64)) * self.longest) * (1 + 1e-9)
        return exact_products((self.doubles if size < 2.0**52 else self.vectors)[rows], query, size)

    def span(self, label: int) -> tuple[int, int]:
        """The rows of a label lie together."""
        return tuple(np.searchsorted(self.labels, [label, label + 1]))

    def intervals(self, queries: np.ndarray, turn: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper bound of the scores of queries with the rows a to b."""
        turned = queries.astype(np.float64) @ turn.T
        low, bits = turned.min(axis=1), turned.shape[1]
        step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
        cut = np.rint(np.divide(turned - low[:, None], step[:, None], out=np.zeros_like(turned), where=step[:, None] > 0)).astype(np.uint8)
        changed = np.abs(turned - (low[:, None] + step[:, None] * cut)).sum(axis=1)
        codes = self.codes[a:b]
        common = np.zeros((len(queries), b - a), np.int32)
        for plane in range(PLANES):
            words = _words((cut >> plane) & 1 == 1)
            for w in range(words.shape[1]):
                common += np.bitwise_count(words[:, None, w] & codes[None, :, w]).astype(np.int32) << plane
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        # <signs, low + step cut> with signs of -1 and 1
        met = low[:, None] * (2 * ones - bits) + step[:, None] * (2.0 * common - cut.sum(axis=1, dtype=np.float64)[:, None])
        unit = np.divide(1.0, self.direction[a:b], out=np.zeros(b - a), where=self.direction[a:b] > 0)
        along, off = met * unit, changed[:, None] * unit
        norms = np.linalg.norm(queries.astype(np.float64), axis=1)[:, None]
        across = np.sqrt(np.maximum(norms**2 - np.maximum(np.abs(along) - off, 0)**2, 0))
        guess = self.align[a:b] * along
        # the last term stands for rounding
        width = self.align[a:b] * off + self.rest[a:b] * across + 1e-9 * (norms * self.norm[a:b] + 1)
        return guess, guess - width, guess + width


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _leading(guess: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest estimates that are finite."""
    found = np.argpartition(-guess, k - 1)[:k] if len(guess) > k else np.arange(len(guess))
    return found[np.isfinite(guess[found])]


def _positives(block: Block, anchors: pa.Table, queries: np.ndarray, turn: np.ndarray, search: Search) -> list[tuple]:
    """(anchor_id, vec_id, score): the best rows of the label within the block."""
    out, k = [], search.positives
    ids, labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    for label in np.unique(labels):
        a, b = block.span(label)
        if a == b:
            continue
        mine, near = np.flatnonzero(labels == label), block.ids[a:b]
        for part in np.array_split(mine, -(-len(mine) * (b - a) // TILE)):
            guess, _, high = block.intervals(queries[part], turn, a, b)
            itself = ids[part][:, None] == near
            guess[itself], high[itself] = -np.inf, -np.inf
            for row, q in enumerate(part):
                scores = block.scores(queries[q], a + _leading(guess[row], SEEDS * k))
                least = np.sort(scores)[-k] if len(scores) >= k else np.finfo(float).min
                left = np.flatnonzero(high[row] >= least)
                scores = block.scores(queries[q], a + left)
                out += [(int(ids[q]), int(near[left[i]]), int(scores[i])) for i in _best(scores, near[left], k)]
    return out


def _negatives(block: Block, anchors: pa.Table, queries: np.ndarray, turn: np.ndarray, search: Search) -> list[tuple]:
    """(anchor_id, positive_id, positive_score, vec_id, score): the best rows of other labels within the range of each positive."""
    out, k, n = [], search.negatives, len(block.ids)
    ids, labels, wanted = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["wanted"].to_pylist()
    for part in np.array_split(np.arange(len(ids)), -(-len(ids) * n // TILE)):
        guess, low, high = block.intervals(queries[part], turn, 0, n)
        for row, q in enumerate(part):
            a, b = block.span(labels[q])
            guess[row, a:b], high[row, a:b] = -np.inf, -np.inf
            ranges, open_ = [], np.zeros(n, bool)
            for score in sorted({w["score"] for w in wanted[q] if w["score"] >= 0}):
                floor, ceiling = -(-score * search.low // 100), score * search.high // 100
                # rows with estimates below the ceiling are scored; those that lie in the range give the threshold
                scores = block.scores(queries[q], _leading(np.where(guess[row] <= ceiling, guess[row], -np.inf), SEEDS * k))
                scores = scores[(scores >= floor) & (scores <= ceiling)]
                least = max(floor, int(np.sort(scores)[-k])) if len(scores) >= k else floor
                open_ |= (high[row] >= least) & (low[row] <= ceiling)
                ranges.append((score, floor, ceiling))
            left = np.flatnonzero(open_)
            scores, chosen = block.scores(queries[q], left), {}
            for score, floor, ceiling in ranges:
                fit = np.flatnonzero((scores >= floor) & (scores <= ceiling))
                chosen[score] = fit[_best(scores[fit], block.ids[left[fit]], k)]
            out += [(int(ids[q]), w["vec_id"], w["score"], int(block.ids[left[i]]), int(scores[i]))
                    for w in wanted[q] for i in chosen.get(w["score"], ())]
    return out


def _scan(find: Callable, names: list[str], dims: int, search: Search):
    """Tasks that hold the rows of a block (kind 0) while its anchors (kind 1) stream past."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, block, at = _isometry(dims, search.seed), [], None, None
        for batch in batches:
            for number in np.unique(batch.column("block").to_numpy()):
                mine = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch.column("block"), number))
                if number != at:
                    held, block, at = [], None, number
                kinds = mine["kind"].to_numpy()
                if (kinds == 0).any():
                    held.append(mine.filter(pa.array(kinds == 0)))
                anchors = mine.filter(pa.array(kinds == 1))
                if not anchors.num_rows or not held:
                    continue
                block = block or Block(pa.concat_tables(held), dims)
                queries = _matrix(anchors["ints"].combine_chunks(), dims)
                found = find(block, anchors, queries, turn, search)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)
    return scan


def _meet(codes: DataFrame, anchors: DataFrame, blocks: int, find: Callable, names: list[str], dims: int, search: Search) -> DataFrame:
    """The results of `find` for every block and all anchors."""
    empty = "CAST(NULL AS array<struct<vec_id:long,score:long>>) AS wanted"
    rows = codes.selectExpr("block", "0 AS kind", "vec_id", "label", "code", "align", "direction", "rest", "norm", "ints", empty)
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).selectExpr(
        "block", "1 AS kind", "vec_id", "label", "CAST(NULL AS binary) AS code", *[f"CAST(NULL AS double) AS {c}" for c in ("align", "direction", "rest", "norm")],
        "ints", "wanted" if "wanted" in anchors.columns else empty)
    dealt = rows.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_scan(find, names, dims, search), ", ".join(f"{x} long" for x in names))


# --- mining -----------------------------------------------------------------------------------

def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k highest scores per group with `rank` from 1, ties by smaller id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, search: Search = Search()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors(vec_id, label, embedding); `anchors` says over these columns which rows ask.
    """
    codes, dims, blocks = coded(vectors, anchors, search)
    asking = codes.filter("anchor").select("vec_id", "label", "ints")
    near = _meet(codes, asking, blocks, _positives, ["anchor_id", "vec_id", "score"], dims, search)
    positives = _ranked(near, search.positives, "anchor_id").groupBy(F.col("anchor_id").alias("_a")).agg(
        F.collect_list(F.struct("vec_id", "score")).alias("wanted"))
    wanting = cut_lineage(asking.join(positives, F.col("vec_id") == F.col("_a")).drop("_a"), "positives")
    far = _meet(codes, wanting, blocks, _negatives, ["anchor_id", "positive_id", "positive_score", "vec_id", "score"], dims, search)
    best = _ranked(far, search.negatives, "anchor_id", "positive_id", "positive_score")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
