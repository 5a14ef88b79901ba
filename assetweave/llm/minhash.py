"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words; a shorter text is one shingle. Its weight is (1 + ln tf) times the mean inverse
document frequency of its words. Word frequencies are counted over all documents in a table of 2^18 hashed features, so
what each task holds is bounded. The frequency only moves a weight between 1 and 1 + `damping`: a word changed in a copy
is rare by nature, and undamped weights would push true copies below the threshold.

Signatures have `bands` x `rows` samples. Within a band's bucket every member is first compared with one of them, the
one that shares most buckets with others, which is mostly the original of the copies. Links found so give components. Then,
in buckets that still hold several components, each member outside the bucket's largest one is compared with all members of
other components, in groups of two blocks that hold their shingles in arrays; for each such member and component one
link is kept. So no link between different components is left out, and no group's pairs are all written. Each comparison is
the weighted Jaccard similarity of whole texts.

Texts without words (null and empty ones too) link with nothing. Rows with equal text are one node; its document is the
smallest doc_id, nulls last. A class is named by its smallest doc_id. Texts of any length take part whole; what a task holds
follows from the longest ones of a block. An empty table gives an empty table. Only doc_id and text are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import connected, schema, sorted_groups
from assetweave.llm.words import text_hashes, word_hashes
from assetweave.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
FEATURES = 1 << 18
DAMPING = 0.25
STEP = 512  # shingles that are sampled at once
BLOCK = 500  # texts on each side of a group that is compared at once
TEXT = ["_text_a", "_text_b"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 at 2^16 midpoints, by bisection."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def shingles(text: str, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights."""
    return shingles_of(word_hashes(text), idf, size)


def shingles_of(words: np.ndarray, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return words, np.zeros(0)
    size = min(size, len(words))
    rare = idf[(words >> np.uint64(20)) & np.uint64(FEATURES - 1)]
    n = len(words) - size + 1
    mark, weight = np.zeros(n, np.uint64), np.zeros(n)
    for k in range(size):
        mark = (mark ^ words[k:k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        mark ^= mark >> np.uint64(29)
        weight += rare[k:k + n]
    order = np.argsort(mark)
    mark, weight = mark[order], weight[order] / size
    new = np.append(True, mark[1:] != mark[:-1])
    if new.all():
        return mark, weight
    first = np.flatnonzero(new)
    return mark[first], (1 + np.log(np.diff(np.append(first, n)))) * weight[first]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    low = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


class Sampler:
    """Consistent weighted samples of a shingle set, folded into band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.shape = (bands, rows)
        self.seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64))[:, None]
        self.r = _gamma_quantiles()
        self.log_c = np.log(self.r).astype(np.float32)
        self.r = self.r.astype(np.float32)
        self.steps = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)

    def band_keys(self, mark: np.ndarray, weight: np.ndarray) -> np.ndarray:
        log_w = np.log(weight).astype(np.float32)
        best, at, level = None, None, None
        for begin in range(0, len(mark), STEP):  # stays in the cache; every shingle takes part
            z = (mark[None, begin:begin + STEP] ^ self.seeds) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD1B54A32D192ED03)
            # three independent numbers of 16 bits: for r, for beta and for c
            parts = z.view(np.uint16).reshape(*z.shape, 4)
            r = self.r[parts[..., 3]]
            beta = self.steps[parts[..., 1]]
            t = np.floor(log_w[None, begin:begin + STEP] / r + beta)
            a = self.log_c[parts[..., 2]] - r * (t - beta + np.float32(1))
            low = a.argmin(axis=1)
            rows = np.arange(len(low))
            here, mine, lift = a[rows, low], mark[begin + low], t[rows, low]
            if best is None:
                best, at, level = here, mine, lift
            else:
                less = here < best
                best, at, level = np.where(less, here, best), np.where(less, mine, at), np.where(less, lift, level)
        sample = _mix(at ^ _mix(level.astype(np.int64).view(np.uint64) + np.uint64(1)))
        keys = np.zeros(self.shape[0], np.uint64)
        for k in range(self.shape[1]):
            keys = _mix(keys * np.uint64(3) ^ sample.reshape(self.shape)[:, k])
        return keys.view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per hashed word, of one task."""
    counts = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for words in text_hashes(batch.column(0)):
            counts[np.unique((words >> np.uint64(20)) & np.uint64(FEATURES - 1)).astype(np.int64)] += 1
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["feature", "n"])


def inverse_frequencies(docs: DataFrame, damping: float = DAMPING) -> np.ndarray:
    """Weight per hashed word, between 1 and 1 + damping. One row per feature reaches the driver, 2^18 at most."""
    counted = docs.select("text").mapInArrow(_counts, schema("feature int, n long")).groupBy("feature").agg(F.sum("n").alias("n"))
    held, total = counted.toArrow(), docs.count()
    df = np.zeros(FEATURES)
    df[held["feature"].to_numpy()] = held["n"].to_numpy()
    return 1 + damping * np.log((total + 1) / (df + 1)) / np.log(total + 2)


def _sign(idf: np.ndarray, size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands, rows)
        for batch in batches:
            at, keys, total = [], [], []
            for i, words in enumerate(text_hashes(batch.column(3))):
                mark, weight = shingles_of(words, idf, size)
                if len(mark):
                    at.append(i)
                    keys.append(sampler.band_keys(mark, weight))
                    total.append(float(weight.sum()))
            rows_ = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows_) for k in range(3)],
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(total, pa.float64())],
                                             ["doc_id", *TEXT, "keys", "weight"])
    return run


def _verify(idf: np.ndarray, size: int, similarity: float):
    """Pairs sorted by their hub, whose shingles are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(batch.column(k) for k in range(3)), text_hashes(batch.column(3)), strict=True):
                if a.as_py() != last:
                    last, kept = a.as_py(), shingles(x.as_py(), idf, size)
                if weighted_jaccard(kept, shingles_of(y, idf, size)) >= similarity:
                    u.append(last), v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def _cross(idf: np.ndarray, size: int, similarity: float):
    """Links between components within groups of two blocks: for each open member one link to each other component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, 4):
            node, component, opened, member = (t[c].to_numpy() for c in ("node", "component", "opened", "member"))
            rows = np.flatnonzero(opened == 1)
            others = np.flatnonzero(member == 1)
            if len(rows) and len(others):
                u, v = _cross_links(rows, others, component, [shingles_of(x, idf, size) for x in text_hashes(t["text"].combine_chunks())], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], ["u", "v"])
    return run


def _cross_links(rows: np.ndarray, others: np.ndarray, component: np.ndarray, sets: list, similarity: float):
    """Each of `rows` against all `others` of other components at once."""
    marks, local = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    begin = np.append(0, np.cumsum([len(s[0]) for s in sets]))
    total = np.array([s[1].sum() for s in sets])
    mine = [local[begin[o]:begin[o + 1]] for o in others]
    flat, weight = np.concatenate(mine), np.concatenate([sets[o][1] for o in others])
    cuts = np.append(0, np.cumsum([len(m) for m in mine]))[:-1]
    dense, u, v = np.zeros(len(marks)), [], []
    for r in rows:
        at = local[begin[r]:begin[r + 1]]
        dense[at] = sets[r][1]
        low = np.add.reduceat(np.minimum(dense[flat], weight), cuts)
        dense[at] = 0
        near = np.flatnonzero((low >= similarity * (total[others] + total[r] - low)) & (component[others] != component[r]))
        _, first = np.unique(component[others[near]], return_index=True)
        u += [r] * len(first)
        v += others[near[first]].tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def _text_key():
    return [F.xxhash64(F.lit(5), F.col("text")).alias(TEXT[0]), F.xxhash64(F.col("text"), F.lit(3)).alias(TEXT[1])]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS, damping: float = DAMPING) -> DataFrame:
    """A row per document: doc_id, the text's key, class_id, kept."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    idf = inverse_frequencies(docs, damping)
    keyed = docs.select("doc_id", *_text_key(), "text")
    signed = keyed.filter(F.col("text").isNotNull()).mapInArrow(
        _sign(idf, size, bands, rows), schema(f"doc_id {id_type}, {TEXT[0]} long, {TEXT[1]} long, keys array<long>, weight double"))
    # one node per text; its number is fixed by writing the table
    nodes = cut_lineage(signed.groupBy(*TEXT).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"),
                                                  F.first("weight").alias("weight")).select(
        F.monotonically_increasing_id().alias("node"), "*"), "signatures")
    buckets = nodes.select("node", "weight", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(buckets.join(shared, ["band", "key"]), "buckets")
    texts = _texts(docs, nodes, members.select("node").distinct())
    # totals differ by the share of the smaller one at most
    apart = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = members.join(central, "node").groupBy("band", "key").agg(
        F.max(F.struct("met", -F.col("node"), "weight")).alias("h")).select("band", "key", (-F.col("h.col2")).alias("hub"), F.col("h.weight").alias("hub_weight"))
    stars = members.join(hubs, ["band", "key"]).filter((F.col("node") != F.col("hub")) & apart(F.col("weight"), F.col("hub_weight"))) \
        .select("hub", "node").distinct()
    links = _star_links(stars, texts, idf, size, similarity)
    first = cut_lineage(connected(members.select("node").distinct(), links), "first_classes")
    links = links.union(_open_links(members, first, texts, idf, size, similarity))
    classes = connected(nodes.select("node"), links)
    named = cut_lineage(nodes.select("node", "doc_id", *TEXT).join(classes, "node"), "classes")
    best = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("chosen"))
    named = named.join(best, "component").select(
        *[F.col(c).alias(f"_{c}") for c in TEXT], F.col("doc_id").alias("_first"), "class_id",
        (F.col("node") == F.col("chosen")).alias("_chosen"))
    return keyed.drop("text").join(named, (F.col(TEXT[0]) == F.col(f"_{TEXT[0]}")) & (F.col(TEXT[1]) == F.col(f"_{TEXT[1]}")), "left") \
        .select("doc_id", *TEXT, F.when(F.col("_chosen").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                F.when(F.col("_chosen").isNull(), True).otherwise(F.col("_chosen") & F.col("doc_id").eqNullSafe(F.col("_first"))).alias("kept"))


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a bucket, as a written table."""
    known = wanted.join(nodes, "node").select("node", F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in TEXT])
    a, b = _text_key()
    return cut_lineage(docs.select("doc_id", "text").join(
        known, (a == F.col("_" + TEXT[0])) & (b == F.col("_" + TEXT[1])) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("node", "text").dropDuplicates(["node"]), "candidate_texts")


def _star_links(stars: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of a hub and a member whose texts are similar enough, as a written table."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("hub", "node"))
    both = stars.join(right, "node").join(left, "hub").select("hub", "node", "text_hub", "text_node")
    return cut_lineage(both.mapInArrow(_verify(idf, size, similarity), schema("u long, v long")), "links")


def _open_links(members: DataFrame, first: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, similarity: float) -> DataFrame:
    """Links between the components that still meet in a bucket, as a written table."""
    named = members.select("band", "key", "node").join(first, "node")
    sizes = named.groupBy("band", "key", "component").count()
    mixed = sizes.groupBy("band", "key").agg(
        F.count("*").alias("parts"), F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("n")) \
        .filter("parts > 1").select(
        "band", "key", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.count")) / BLOCK).cast("int").alias("ni"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"))
    rows = cut_lineage(named.join(mixed, ["band", "key"]), "open_buckets")
    # open members lie in one block on each side, the others in one block of the second side
    opened = F.col("component") != F.col("main")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    as_member = rows.withColumn("j", place("nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))) \
        .select("band", "key", "i", "j", "node", "component", F.lit(0).alias("opened"), F.lit(1).alias("member"))
    as_open = rows.filter(opened).withColumn("i", place("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))) \
        .select("band", "key", "i", "j", "node", "component", F.lit(1).alias("opened"), F.lit(0).alias("member"))
    groups = as_member.unionByName(as_open).groupBy("band", "key", "i", "j", "node", "component").agg(
        F.max("opened").alias("opened"), F.max("member").alias("member"))
    dealt = groups.join(texts, "node").select("band", "key", "i", "j", "node", "component", "opened", "member", "text") \
        .repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return cut_lineage(dealt.mapInArrow(_cross(idf, size, similarity), schema("u long, v long")).distinct(), "open_links")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its columns, whatever these are called; of rows with equal id and text one stays."""
    plain = docs.select("doc_id", "text")
    found = near_duplicates(plain, similarity).filter("kept").select("doc_id", *TEXT).distinct()
    rows = docs.select("doc_id", *_text_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = ["doc_id", *TEXT]

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(*[F.col(c).alias(f"_{c}") for c in same])
        on = F.lit(True)
        for c in same:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(other, on, how)
    kept = meet(rows, found, "left_semi")
    # only rows that do repeat are brought together
    repeats = cut_lineage(plain.groupBy("doc_id", *_text_key()).count().filter("count > 1"), "repeats")
    if not repeats.isEmpty():
        kept = meet(kept, repeats, "left_anti").unionByName(meet(kept, repeats, "left_semi").dropDuplicates(same))
    return kept.select("_row.*")
