"""Near-duplicate vectors with a forest of random-projection trees.

Each tree splits the unit sphere again and again by a random direction at the median of a bounded sample. Vectors close to
a split go to both sides, so near vectors part less often. Below the nodes that the sample can still split, the tree goes on
with one random direction per level through the node's centre, to a depth that follows from the number of vectors; the
model stays bounded while leaves keep their size. Every vector is put into every tree.

Inside a group of copies every split parts many links. Where the sampled members of a node link, its split is measured: it
spills more until few of their links are lost, and if both sides would then keep so much that no comparison is saved, the
node is a dense leaf, however large. The number of trees follows from the depth.

Within a leaf all vectors are compared by cosine in double precision. A leaf above `BLOCK` vectors is cut into blocks, and
each pair of blocks is a group of its own; vectors that were together in a dense leaf before are not compared again. A pair
that shares several leaves is counted in the smallest of them; what a leaf emits are counts per vector and a spanning forest
of its links, never the pairs. Equal vectors are one node with a number of ids.

Vectors that are null, zero or hold null or non-finite components link with nothing, and neither do vectors of different
lengths. Rows with a null id link with nothing. An id that comes more than once counts once per distinct vector.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import connected, schema, sorted_groups
from assetweave.session import cut_lineage

COSINE = 0.9
TREES, LEAF, SAMPLE = 12, 256, 20_000
SPILL = 0.25  # of the spread of a pair at the threshold along a random direction
BLOCK = 1024
FEWEST = 16  # of the sample, for a split at its median
RECALL, LOSS = 0.99, 0.07  # of links at the threshold; share that a split may part
MEASURED, LINKS = 192, 30  # sampled members whose links are looked at, and the fewest links that tell
WIDER = 1.0, 1.5, 2.0, 3.0, 4.0  # spill of a split, in margins
SAVES = 0.7  # with more of the members on either side a split saves no comparison
DENSE = 0.1  # share of linked pairs in the sample of a node that is not split further


@dataclass
class Tree:
    """Nodes in arrays. `below` levels of shared directions follow a node without children."""

    direction: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    centre: np.ndarray
    below: np.ndarray
    levels: np.ndarray
    wider: np.ndarray  # spill of each split, in margins
    dense: np.ndarray  # leaves left whole because their members link


def trees_for(total: int, leaf: int, least: int) -> int:
    """So many trees that a link at the threshold, parted with probability `LOSS` a level, is found with probability `RECALL`."""
    together = (1 - LOSS) ** max(0.0, np.log2(max(1.0, total / leaf)))
    return least if together >= RECALL else max(least, int(np.ceil(np.log(1 - RECALL) / np.log(1 - together))))


def grow(sample: np.ndarray, total: int, leaf: int, made: np.random.Generator, margin: float = 0.0, cosine: float = COSINE) -> Tree:
    size, each = sample.shape[1], max(1.0, total / max(1, len(sample)))
    direction, threshold, children, centre, below, wider, dense = [], [], [], [], [], [], []

    def unit() -> np.ndarray:
        x = made.standard_normal(size)
        return x / np.linalg.norm(x)

    def links_in(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Linked pairs of some members, and the number of pairs looked at."""
        few = rows if len(rows) <= MEASURED else made.choice(rows, MEASURED, replace=False)
        a, b = np.nonzero(np.triu(sample[few] @ sample[few].T >= cosine, 1))
        return few[a], few[b], len(few) * (len(few) - 1) // 2

    def node(rows: np.ndarray) -> int:
        me = len(direction)
        held = len(rows) * each
        wider.append(1.0), dense.append(False)
        direction.append(np.zeros(size)), threshold.append(0.0), children.append((-1, -1)), below.append(0)
        centre.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(size))
        if held > leaf and len(rows) >= FEWEST:
            d = unit()
            at = sample[rows] @ d
            cut = float(np.median(at))
            left = at <= cut
            if 0 < left.sum() < len(rows):
                a, b, _ = links_in(rows)
                if len(a) >= LINKS and margin > 0:
                    low, high = np.minimum(sample[a] @ d, sample[b] @ d) - cut, np.maximum(sample[a] @ d, sample[b] @ d) - cut
                    fits = [w for w in WIDER if ((low <= -w * margin) & (high > w * margin)).mean() <= LOSS]
                    wide = fits[0] if fits else np.inf
                    if max((at <= cut + wide * margin).mean(), (at > cut - wide * margin).mean()) > SAVES:
                        dense[me] = True
                        return me
                    wider[me] = wide
                direction[me], threshold[me] = d, cut
                children[me] = (node(rows[left]), node(rows[~left]))
                return me
        if held > leaf and len(rows) > 1 and margin > 0:
            a, _, pairs = links_in(rows)
            if len(a) >= DENSE * pairs:
                dense[me] = True
                return me
        below[me] = max(0, int(np.ceil(np.log2(max(1.0, held / leaf)))))
        return me
    node(np.arange(len(sample)))
    return Tree(np.array(direction), np.array(threshold), np.array(children), np.array(centre), np.array(below),
                np.array([unit() for _ in range(max(1, max(below)))]), np.array(wider), np.array(dense))


def leaves_of(x: np.ndarray, tree: Tree, number: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all leaves of a tree that the rows of x reach."""
    rows_out, leaf_out, stack = [], [], [(0, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if not len(rows):
            continue
        left, right = tree.children[at]
        if left >= 0:
            away = x[rows] @ tree.direction[at] - tree.threshold[at]
            spill = margin * tree.wider[at]
            stack += [(left, rows[away <= spill]), (right, rows[away > -spill])]
            continue
        bits = np.zeros(len(rows), np.int64)
        for level in range(tree.below[at]):
            d = tree.levels[level]
            away = x[rows] @ d - tree.centre[at] @ d
            low, high = away <= margin, away > -margin
            bits = np.concatenate([bits[low] * 2, bits[high] * 2 + 1])
            rows = np.concatenate([rows[low], rows[high]])
        rows_out.append(rows)
        leaf_out.append((np.int64(number) << 52) + (np.int64(at) << 30) + bits)
    return np.concatenate(rows_out), np.concatenate(leaf_out)


def _unit(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision; all of one length, none of them zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(trees: list[Tree], margin: float):
    dense = np.sort(np.concatenate([(np.int64(i) << 52) + (np.flatnonzero(t.dense).astype(np.int64) << 30) for i, t in enumerate(trees)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1))
            found = [leaves_of(x, t, i, margin) for i, t in enumerate(trees)]
            rows, leaves = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.lexsort((leaves, rows))
            rows, leaves = rows[order], leaves[order]
            ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(x))))
            home = np.full(len(x), -1, np.int64)  # first dense leaf
            known = np.flatnonzero(np.isin(leaves, dense))[::-1]
            home[rows[known]] = leaves[known]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves, pa.int64())), pa.array(home)],
                ["node", "vector", "copies", "leaves", "home"])
    return run


def _links_of(node: np.ndarray, x: np.ndarray, copies: np.ndarray, leaves: pa.ListArray, leaf: int, side: np.ndarray, cosine: float):
    """(node, counted links, root) of those vectors of a leaf, or of two of its blocks, that have links there."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    held = np.flatnonzero(near.any(axis=1))
    if not len(held):
        return None
    near, node, copies = near[np.ix_(held, held)], node[held], copies[held]
    root = np.arange(len(held))
    while True:  # smallest neighbour, then the neighbour's neighbour
        low = np.minimum(root, np.where(near, root[None, :], len(held)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    mine = leaves.take(pa.array(held))
    of, one = np.repeat(np.arange(len(held)), mine.value_lengths().to_numpy()), mine.flatten().to_numpy()
    of, one = of[one < leaf], one[one < leaf]
    order = np.argsort(one, kind="stable")
    for rows in np.split(of[order], np.flatnonzero(np.diff(one[order])) + 1):
        if len(rows) > 1:
            near[np.ix_(rows, rows)] = False
    return node, near @ copies, node[root]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, 3):
            if t.num_rows > 1 and (found := _links_of(
                    t["node"].to_numpy(), _unit(t["vector"].combine_chunks()), t["copies"].to_numpy(), t["leaves"].combine_chunks(),
                    t["leaf"][0].as_py(), t["side"].to_numpy(), cosine)):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in found], ["node", "links", "root"])
    return run


def _valid(name: str):
    whole = F.coalesce(F.forall(name, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return F.col("vec_id").isNotNull() & whole & F.exists(name, lambda e: e != 0)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
                 spill: float = SPILL) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    keyed = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("_a"), F.xxhash64(F.lit(3), "embedding").alias("_b"))
    keyed = keyed.withColumn("_ok", F.coalesce(_valid("embedding"), F.lit(False)))
    nodes = cut_lineage(keyed.filter("_ok").groupBy("_a", "_b").agg(
        F.first("embedding").alias("vector"), F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "*", F.size("vector").alias("length")), "vectors")
    found = [_linked(nodes.filter(F.col("length") == r[0]), r[0], r[1], cosine, trees, leaf, sample, spill)
             for r in nodes.groupBy("length").count().collect()]
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                              F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    edges = links.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()
    classes = connected(nodes.select("node"), edges)
    named = nodes.select("node", "_a", "_b", "first", "copies").join(classes, "node").join(counts, "node", "left")
    named = cut_lineage(named, "vector_classes")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select(
        F.col("_a").alias("_na"), F.col("_b").alias("_nb"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.drop("embedding").join(named, F.col("_ok") & (F.col("_a") == F.col("_na")) & (F.col("_b") == F.col("_nb")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _linked(nodes: DataFrame, length: int, total: int, cosine: float, trees: int, leaf: int, sample: int, spill: float) -> DataFrame:
    """(node, links, root) from all leaves, as a written table. The forest is fitted on at most `sample` vectors."""
    share = min(1.0, 2 * sample / total)
    drawn = nodes.select("vector", F.xxhash64("node").alias("h")).filter(
        F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("h").limit(sample).select("vector").toArrow()
    x = _unit(drawn["vector"].combine_chunks()) if drawn.num_rows else np.zeros((0, length))
    made = np.random.default_rng(11)
    margin = spill * float(np.sqrt((2 - 2 * cosine) / length))
    forest = [grow(x, total, leaf, made, margin, cosine) for _ in range(trees_for(total, leaf, trees))]
    routed = cut_lineage(nodes.select("node", "vector", "copies").mapInArrow(_route(forest, margin), schema(
        f"node long, vector {nodes.schema['vector'].dataType.simpleString()}, copies long, leaves array<long>, home long")), "leaves")
    placed = routed.withColumn("leaf", F.explode("leaves"))
    sizes = placed.groupBy("leaf", "home").count()
    # of a large leaf those that were together in one dense leaf before are compared with the others only
    earlier = F.when((F.col("home") >= 0) & (F.col("home") < F.col("leaf")), F.struct("count", "home"))
    large = sizes.groupBy("leaf").agg(F.sum("count").alias("all"), F.max(earlier).alias("top")).filter(F.col("all") > BLOCK)
    done = F.coalesce("top.count", F.lit(0))
    large = cut_lineage(large.select(F.col("leaf").alias("_leaf"), F.coalesce("top.home", F.lit(-2)).alias("_met"),
                                     F.ceil(done / BLOCK).cast("int").alias("_old"),
                                     F.ceil((F.col("all") - done) / BLOCK).cast("int").alias("_new")), "large_leaves")
    placed = placed.join(large, placed.leaf == F.col("_leaf"), "left")
    met, mark = F.col("home") == F.col("_met"), F.xxhash64("node", "leaf")
    old, new = F.coalesce("_old", F.lit(0)), F.coalesce("_new", F.lit(1))
    placed = placed.withColumn("_mine", F.when(met, F.pmod(mark, old)).otherwise(old + F.pmod(mark, new)).cast("int"))
    others = F.when(new > 0, F.sequence(F.when(met, old).otherwise(F.lit(0)), old + F.greatest(new, F.lit(1)) - 1))
    placed = placed.withColumn("_other", F.explode(others))
    groups = placed.select("leaf", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"),
                           (F.col("_mine") > F.col("_other")).alias("side"), "node", "vector", "copies", "leaves")
    dealt = groups.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    return cut_lineage(dealt.select("leaf", "i", "j", F.col("side").cast("int").alias("side"), "node", "vector", "copies", "leaves")
                       .mapInArrow(_compare(cosine), schema("node long, links long, root long")), "vector_links")
