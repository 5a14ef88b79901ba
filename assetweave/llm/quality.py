"""Document quality by co-training two views.

The text view sees hashed words and how a text is written; the metadata view sees language, source and length. Each view
has a logistic classifier. In every round each view labels the unlabelled documents of which it is sure, and the other
view learns from them. Then each view is calibrated on labelled documents that were held back, and a logistic combination of
the two calibrated views, fitted on the same documents, scores every document. The target is quality 1 without toxicity.

Learning uses at most `labelled` labelled documents, those with the smallest hash of their id, and all unlabelled ones:
their features are written once, every round looks at all of them, and the views are fitted on sums over all that are sure
(gradients for the text view, counts per set of metadata features for the other). Scoring covers all documents and whole texts. Words that enter the model are those of the vocabulary of hashed features whose
rate differs between the classes by more than `least_z` standard errors.

A null text is an empty one; null metadata are values of their own. Labels that are null, or of documents that don't exist,
are not used; a document with several label rows counts with each, and all of them teach or all calibrate. Documents that
repeat count as often as they come; an empty table gives an empty table, and other columns play no part. Without both classes among the labels every score is the share
of good labels, or one half.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import schema
from assetweave.llm.words import coded, slices
from assetweave.session import cut_lineage

LABELLED, ROUNDS = 12_000, 3
FEATURES, META = 1 << 18, 1 << 10
LEAST_Z = 4.0
SURE = 0.97
TAUGHT = 0.5  # weight of a document that the other view has labelled
RIDGE = 0.2, 4.0  # of the text and of the metadata view
STYLE = 8


def _look(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word (-1 without) and style of each chunk."""
    n = len(chunks)
    words = [c if c.isalnum() else "".join(filter(str.isalnum, c)) for c in chunks]
    marks = np.fromiter((xxhash.xxh64_intdigest(w.lower()) % FEATURES if w else -1 for w in words), np.int32, n)
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, chunks), np.int64, n)
    # what a character is, once per distinct one
    seen, at = np.unique(points, return_inverse=True)
    kinds = np.array([[c.isalnum(), c.isalpha(), c.isdigit(), c.isupper(), c.islower() or c.istitle() and not c.isupper()]
                      for c in map(chr, seen.tolist())], np.float32).reshape(-1, 5)
    total = np.concatenate([np.zeros((1, 5)), np.cumsum(kinds[at], axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    word, letters, digits, upper, lower = (total[ends] - total[ends - sizes]).T
    rest = sizes - word
    style = np.column_stack([(word > 1) & (upper > 0) & (lower == 0), word == 0, rest > 1, digits > 0, np.minimum(letters, 20) / 10,
                             rest / np.maximum(1, sizes)]).astype(np.float32)
    return marks, style


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashed words and style of each text."""
    for begin, end in slices(texts):
        chunks, codes, offsets = coded(texts.slice(begin, end - begin))
        marks, looks = _look(chunks)
        filled = np.array([bool(c) for c in chunks], bool)
        for a, b in zip(offsets, offsets[1:], strict=False):
            held = codes[a:b][filled[codes[a:b]]]
            words = np.unique(marks[held])
            share = looks[held].mean(axis=0) if len(held) else np.zeros(STYLE - 2, np.float32)
            yield words[words >= 0], np.append(share, [len(words) / max(1, len(held)), np.log1p(len(held)) / 10]).astype(np.float32)


def meta_features(lang, source, n_chars) -> list[int]:
    size = "none" if n_chars is None else int(np.log2(max(1, n_chars)) * 2)
    return sorted({xxhash.xxh64_intdigest(f"{k}={v}") % META for k, v in (("lang", lang), ("source", source), ("size", size))})


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 8, inner: int = 20) -> Linear:
    """Ridge logistic regression by Newton's method with conjugate gradients. Large products stay in single precision."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)

    def times(v: np.ndarray) -> np.ndarray:
        return (x @ v[:-1].astype(x.dtype)).astype(np.float64) + v[-1]

    def back(v: np.ndarray) -> np.ndarray:
        return np.append((v.astype(x.dtype) @ x).astype(np.float64), v.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(weight * (p - y)) + penalty * w
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -gradient
        d, old = r.copy(), r @ r
        least = max(1e-10, old * 1e-6)
        for _ in range(inner):
            if old < least:
                break
            hd = back(curve * times(d)) + penalty * d
            a = old / (d @ hd)
            step, r = step + a * d, r - a * hd
            now = r @ r
            d, old = r + now / old * d, now
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return Linear(w[:-1], float(w[-1]))


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashed words of the text view
    text: Linear
    meta: Linear
    text_scale: Linear
    meta_scale: Linear
    both: Linear
    constant: float | None = None

    def view_logits(self, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
        a, b = (s.logit(v.logit(x)[:, None]) for v, s, x in ((self.text, self.text_scale, text_x), (self.meta, self.meta_scale, meta_x)))
        return np.clip(np.stack([a, b], axis=1), -12, 12)


class Rows:
    """Sparse rows of ones, with some dense columns behind them."""

    __array_ufunc__ = None  # so that `vector @ rows` comes here
    dtype = np.dtype(np.float64)

    def __init__(self, at: np.ndarray, lengths: np.ndarray, width: int, dense: np.ndarray | None = None):
        self.at, self.lengths, self.width = at, lengths, width
        self.dense = np.zeros((len(lengths), 0), np.float32) if dense is None else dense
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        self.shape = len(lengths), width + self.dense.shape[1]

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, v[self.at], len(self.lengths)) + self.dense @ v[self.width:]

    def __rmatmul__(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.at, v[self.of], self.width), v @ self.dense)

    def __getitem__(self, mask: np.ndarray) -> "Rows":
        return Rows(self.at[mask[self.of]], self.lengths[mask], self.width, self.dense[mask])

    def and_rows(self, more: "Rows") -> "Rows":
        return Rows(*(np.concatenate([getattr(self, k), getattr(more, k)]) for k in ("at", "lengths")), self.width,
                    np.concatenate([self.dense, more.dense]))


def _ones(found: list, width: int, dense: np.ndarray | None = None) -> Rows:
    return Rows(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), np.array([len(f) for f in found], np.int64), width, dense)


def known_words(found: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the vocabulary."""
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == found]


def matrix(words: list[np.ndarray], style: np.ndarray, vocabulary: np.ndarray) -> Rows:
    return _ones([known_words(w, vocabulary) for w in words], len(vocabulary), np.asarray(style, np.float32).reshape(-1, STYLE))


def meta_matrix(found: list[list[int]]) -> Rows:
    return _ones(found, META)


def telling_words(words: list[np.ndarray], y: np.ndarray, least_z: float) -> np.ndarray:
    """Words whose rate differs between the classes. Rare ones are left to the ridge."""
    rate = np.zeros((2, FEATURES))
    for found, one in zip(words, y, strict=True):
        rate[int(one), found] += 1
    n = np.bincount(y.astype(int), minlength=2).clip(1)
    pooled = rate.sum(axis=0) / n.sum()
    z = np.abs(rate[1] / n[1] - rate[0] / n[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero(z >= least_z)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of (text, lang, source, n_chars, ...); the other columns go along."""
    for batch in batches:
        words, style, meta = [], [], []
        rows = zip(text_features(batch.column(0)), *(batch.column(i) for i in (1, 2, 3)), strict=True)
        for (w, s), lang, source, n in rows:
            words.append(w), style.append(s), meta.append(meta_features(lang.as_py(), source.as_py(), n.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(style, pa.list_(pa.float32())),
                                          pa.array(meta, pa.list_(pa.int32())), *batch.columns[4:]],
                                         ["words", "style", "meta", *batch.schema.names[4:]])


def _drawn(docs: DataFrame, most: int):
    """Features of at most `most` rows as arrays on the driver, and a number that rows of one id share."""
    total = docs.count()
    share = min(1.0, 2 * most / max(1, total))
    few = docs.withColumn("_order", F.xxhash64("doc_id")).filter(F.pmod("_order", F.lit(1 << 30)) <= int(share * (1 << 30)))
    # features first, as they are smaller than texts: one task gets them to put them in order
    found = few.select("text", "lang", "source", F.col("n_chars").cast("long"), "_order", "good").mapInArrow(
        _features, schema("words array<int>, style array<float>, meta array<int>, _order long, good int"))
    t = found.orderBy("_order", "good", "meta", "style").limit(most).toArrow()
    held = t["words"].combine_chunks()
    words = [x.values.to_numpy() for x in held]
    style = t["style"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, STYLE)
    return words, style, meta_matrix(t["meta"].to_pylist()), t["good"].to_pylist(), t["_order"].to_numpy()


def _known_features(vocabulary: np.ndarray):
    """Features with the words of the vocabulary; the id comes at place `at`."""
    def run(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[pa.RecordBatch]:
        for batch in _features(batches):
            words = [known_words(w.values.to_numpy(), vocabulary) for w in batch.column(0)]
            named = [("words", pa.array(words, pa.list_(pa.int32()))), ("style", batch.column(1)), ("meta", batch.column(2))]
            named.insert(at, ("doc_id", batch.column(3)))
            yield pa.RecordBatch.from_arrays([x for _, x in named], [x for x, _ in named])
    return run


def _views(batch: pa.RecordBatch, size: int) -> tuple[Rows, Rows]:
    words, style, meta = batch.columns[:3]
    return (Rows(words.flatten().to_numpy(), words.value_lengths().to_numpy(), size, style.flatten().to_numpy().reshape(-1, STYLE)),
            Rows(meta.flatten().to_numpy(), meta.value_lengths().to_numpy(), META))


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, logit) - y * logit


def _sums(text: Linear, mate: Linear, size: int, sure: float):
    """Gradient of the text view over what the metadata view is sure of; behind it the loss and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + STYLE + 3)
        for batch in batches:
            x, meta = _views(batch, size)
            p = _chance(mate.logit(meta))
            taught = (p >= sure) | (p <= 1 - sure)
            x, y = x[taught], (p[taught] > 0.5).astype(float)
            logit = text.logit(x)
            away = _chance(logit) - y
            total += np.concatenate([away @ x, [away.sum(), _loss(logit, y).sum(), len(y)]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "total"])
    return run


def _taught(text: Linear, size: int, sure: float):
    """Number of documents the text view is sure of, per set of metadata features and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            p = _chance(text.logit(_views(batch, size)[0]))
            taught = np.flatnonzero((p >= sure) | (p <= 1 - sure))
            counts.update(zip(map(tuple, batch.column(2).take(pa.array(taught)).to_pylist()), (p[taught] > 0.5).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.list_(pa.int32())), pa.array([int(k[1]) for k in counts], pa.int32()),
                                          pa.array(list(counts.values()), pa.int64())], ["meta", "mark", "n"])
    return run


def fit_text(x: Rows, y: np.ndarray, ridge: float, start: Linear, mate: Linear, new: DataFrame, sure: float, steps: int = 8) -> Linear:
    """Labelled rows and all documents that the other view is sure of: limited-memory quasi-Newton steps on sums over all of
    them, from the curvature of the labelled rows."""
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    size = x.width

    def at(w: np.ndarray) -> tuple[float, np.ndarray, float]:
        model = Linear(w[:-1], float(w[-1]))
        found = new.mapInArrow(_sums(model, mate, size, sure), schema("at int, total double")).groupBy("at").agg(
            F.sum("total").alias("total")).toArrow()
        far = np.zeros(len(w) + 2)
        far[found["at"].to_numpy()] = found["total"].to_numpy()
        logit = model.logit(x)
        away = _chance(logit) - y
        value = _loss(logit, y).sum() + TAUGHT * far[-2] + 0.5 * (penalty * w * w).sum()
        return value, np.append(away @ x, away.sum()) + TAUGHT * far[:-2] + penalty * w, far[-1]
    w = np.append(start.weights, start.bias)
    value, gradient, many = at(w)
    if not many:
        return start
    p = _chance(start.logit(x))
    curve = np.maximum(p * (1 - p), 1e-6) * (1 + TAUGHT * many / len(y))

    def solve(r: np.ndarray) -> np.ndarray:
        out, d, old = np.zeros_like(r), r.copy(), r @ r
        least = max(1e-20, old * 1e-6)
        for _ in range(20):
            if old < least:
                break
            v = curve * (x @ d[:-1] + d[-1])
            hd = np.append(v @ x, v.sum()) + penalty * d
            a = old / (d @ hd)
            out, r = out + a * d, r - a * hd
            now = r @ r
            d, old = r + now / old * d, now
        return out
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, held = gradient.copy(), []
        for s, t in reversed(past):
            held.append((s @ q) / (s @ t))
            q -= held[-1] * t
        step = solve(q)
        for (s, t), a in zip(past, reversed(held), strict=True):
            step += s * (a - (t @ step) / (s @ t))
        step = -step if gradient @ step > 0 else -gradient / (1 + many)
        while True:
            v, g, _ = at(w + step)
            if v <= value + 1e-4 * (gradient @ step) or np.abs(step).max() < 1e-3:
                break
            step = step / 3
        if v > value:
            break
        if step @ (g - gradient) > 0:
            past.append((step, g - gradient))
        w, value, gradient = w + step, v, g
        if np.abs(step).max() < 2e-2:
            break
    return Linear(w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS,
          least_z: float = LEAST_Z, sure: float = SURE) -> Model:
    """A model from (doc_id, text, lang, source, n_chars) and (doc_id, quality, toxic)."""
    return _learn(docs, labels, labelled, rounds, least_z, sure)[0]


def learn_and_score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS,
                    least_z: float = LEAST_Z, sure: float = SURE, least: float = 0.5) -> DataFrame:
    """What `score` gives for the documents that teach: their features are read once."""
    model, every = _learn(docs, labels, labelled, rounds, least_z, sure)
    if every is None:
        return score(docs, model, least)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return every.select("words", "style", "meta", "doc_id").mapInArrow(_score_features(model), schema(f"doc_id {id_type}, {SCORES}")) \
        .withColumn("kept", F.col("score") >= least)


def _learn(docs: DataFrame, labels: DataFrame, labelled: int, rounds: int, least_z: float, sure: float) -> tuple[Model, DataFrame | None]:
    """The model, and the features of all documents where there are any."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    told = labels.filter("quality IS NOT NULL").select(
        F.col("doc_id").alias("_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    words, style, meta, good, order = _drawn(docs.join(told, F.col("doc_id") == F.col("_id")), labelled)
    y = np.array(good, np.float64)
    if len(y) < 20 or len(set(good)) < 2:
        none = Linear(np.zeros(0), 0.0)
        return Model(np.zeros(0, np.int64), none, none, none, none, none, float(y.mean()) if len(y) else 0.5), None
    back = (order >> 32) % 5 == 4  # held back for calibration, all labels of a document together
    seen = ~back
    vocabulary = telling_words([w for w, s in zip(words, seen, strict=True) if s], y[seen], least_z)
    x = matrix(words, style, vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = docs.select("text", "lang", "source", F.col("n_chars").cast("long"), "doc_id").mapInArrow(
        _known_features(vocabulary), schema(f"doc_id {id_type}, words array<int>, style array<float>, meta array<int>"))
    every = cut_lineage(every, "quality_features")
    new = cut_lineage(every.join(told.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_anti")
                      .select("words", "style", "meta"), "quality_unlabelled")
    ones = np.ones(seen.sum())
    text, meta_model = (fit(v[seen], y[seen], ones, ridge) for v, ridge in zip((x, meta), RIDGE, strict=True))
    for _ in range(rounds):
        sets = new.mapInArrow(_taught(text, len(vocabulary), sure), schema("meta array<int>, mark int, n long")) \
            .groupBy("meta", "mark").agg(F.sum("n").alias("n")).toArrow()
        text = fit_text(x[seen], y[seen], RIDGE[0], text, meta_model, new, sure)
        meta_model = fit(meta[seen].and_rows(meta_matrix(sets["meta"].to_pylist())), np.append(y[seen], sets["mark"].to_numpy()),
                         np.append(ones, TAUGHT * sets["n"].to_numpy()), RIDGE[1])
    held = np.ones(back.sum())
    scales = [fit(f.logit(v[back])[:, None], y[back], held, 1e-3) for f, v in ((text, x), (meta_model, meta))]
    model = Model(vocabulary, text, meta_model, *scales, Linear(np.ones(2) / 2, 0.0))
    both = fit(model.view_logits(x[back], meta[back]), y[back], held, 1.0)
    return Model(vocabulary, text, meta_model, *scales, both), every


SCORES = "score double, text_score double, meta_score double"


def _scored(doc_id: pa.Array, logits: np.ndarray, model: Model) -> pa.RecordBatch:
    out = _chance(np.column_stack([model.both.logit(logits), logits]))
    return pa.RecordBatch.from_arrays([doc_id, *[pa.array(out[:, i].copy()) for i in range(3)]], ["doc_id", "score", "text_score", "meta_score"])


def _score_features(model: Model):
    """Scores of (words, style, meta, doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _scored(batch.column(3), model.view_logits(*_views(batch, len(model.words))), model)
    return run


def _score(model: Model):
    """Scores of (text, lang, source, n_chars, doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.constant is None:
            yield from _score_features(model)(_known_features(model.words)(batches, 3))
            return
        for batch in batches:
            same = pa.array(np.full(batch.num_rows, model.constant))
            yield pa.RecordBatch.from_arrays([batch.column(4), same, same, same], ["doc_id", "score", "text_score", "meta_score"])
    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """A row per document: doc_id, score, text_score, meta_score, kept (score of at least `least`)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text", "lang", "source", F.col("n_chars").cast("long"), "doc_id")
    return rows.mapInArrow(_score(model), schema(f"doc_id {id_type}, {SCORES}")) \
        .withColumn("kept", F.col("score") >= least)
