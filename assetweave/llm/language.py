"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, found by a forward pass; a text's is the product over its words. Piece probabilities come
from expectation maximisation over the word counts of labelled texts: expected piece counts from a forward and a backward
pass in Spark, summed per language and piece, whose number is bounded by the vocabulary.

A word is a run of letters in lower case behind the mark for a word's start. Pieces never cross words, so a word is
scored once per worker process. Letters that no piece holds have the same small probability in every language.

At most `per_language` labelled texts of each language are learned from (those with the smallest hash of id and text);
everything is scored. Texts that are null or hold no letter are `und` with score 0; so is everything if no labelled text
holds a letter. Equal scores go to the language first in order. The score is the language's share of the probability. Rows
that repeat get equal results; texts of any length are scored whole, in memory that is linear in the longest of a batch.
An empty table gives an empty table. Of the columns only text, lang and doc_id are read, whatever others are called;
`drop_rejected` carries all of them in one struct.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetweave.llm.common import schema
from assetweave.llm.held import held
from assetweave.llm.words import coded, slices
from assetweave.session import cut_lineage, task_count

PER_LANGUAGE = 1000
ROUNDS = 3
UNKNOWN = 1e-7
CACHE = 200_000  # words that a worker keeps
UNSCALED = 32  # letters of a word: probabilities of its pieces can't multiply to less than a double holds
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"


class Pieces:
    """The pieces of a SentencePiece vocabulary file that hold letters or the word mark, in lower case."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        told = (model.id_to_piece(i) for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        kept = sorted({p for p in told if p == p.lower() and all(c == "▁" or c.isalpha() for c in p) and "▁" not in p[1:]})
        self.number = {p: i for i, p in enumerate(kept)}
        self.longest = max(map(len, kept))
        # a trie as sorted numbers (node, letter) -> node, so that all words take a step together
        nodes, steps, piece = {"": 0}, {}, [-1]
        for p in kept:
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    nodes[p[:i]] = len(nodes)
                    steps[nodes[p[:i - 1]] << 21 | ord(p[i - 1])] = nodes[p[:i]]
                    piece.append(-1)
            piece[nodes[p]] = self.number[p]
        self._steps = np.array(sorted(steps), np.int64)
        self._next = np.array([steps[x] for x in self._steps.tolist()], np.int64)
        self._piece = np.array(piece, np.int32)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers [word, begin, length - 1] of words of one length; -1 where there is none, -2 for an unknown letter."""
        n, k = len(words[0]), min(self.longest, len(words[0]))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.int64)
        out = np.full((len(words), n, k), -1, np.int32)
        for begin in range(n):
            rows, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            for size in range(min(k, n - begin)):
                step = node << 21 | letters[rows, begin + size]
                at = np.minimum(np.searchsorted(self._steps, step), len(self._steps) - 1)
                on = self._steps[at] == step
                rows, node = rows[on], self._next[at[on]]
                if not len(rows):
                    break
                out[rows, begin, size] = self._piece[node]
            first = out[:, begin, 0]
            first[first < 0] = -2
        return out


def pieces(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def forward(lattice: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums [word, end, language], scaled to 1 at every end, and the logarithms of the scales.

    `probability` [piece, language] ends with the rows of an unknown letter (-2) and of no piece (-1).
    """
    n, k = lattice.shape[1:]
    alpha = np.zeros((len(lattice), n + 1, probability.shape[1]))
    scale = np.zeros_like(alpha)
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(k, end) + 1):
            begin = end - size
            # what lies before `begin` is brought to the scale of the end
            ahead = alpha[:, begin] * probability[lattice[:, begin, size - 1]]
            alpha[:, end] += ahead * np.exp(scale[:, begin] - scale[:, end - 1])
        total = alpha[:, end].copy()
        total[total == 0] = 1e-300
        alpha[:, end] /= total
        scale[:, end] = scale[:, end - 1] + np.log(total)
    return alpha, scale


def word_logs(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Log-probabilities [word, language]: the forward pass without scales where no number can get too small for it."""
    n, k = lattice.shape[1:]
    if n > UNSCALED:
        return forward(lattice, probability)[1][:, n]
    alpha = np.zeros((n + 1, len(lattice), probability.shape[1]))
    alpha[0] = 1
    for begin in range(n):
        for size in range(1, min(k, n - begin) + 1):
            piece = lattice[:, begin, size - 1]
            rows = np.flatnonzero(piece != -1)
            if len(rows):
                alpha[begin + size][rows] += alpha[begin][rows] * probability[piece[rows]]
    return np.log(alpha[n])


def expected_counts(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Posterior probability [word, begin, length - 1] of each piece under one language."""
    n, k = lattice.shape[1:]
    alpha, scale = forward(lattice, probability[:, None])
    alpha, scale = alpha[..., 0], scale[..., 0]
    beta, down = np.zeros_like(alpha), np.zeros_like(alpha)
    beta[:, n] = 1
    for begin in range(n - 1, -1, -1):
        for size in range(1, min(k, n - begin) + 1):
            beta[:, begin] += (probability[lattice[:, begin, size - 1]] * beta[:, begin + size]
                               * np.exp(down[:, begin + size] - down[:, begin + 1]))
        total = np.where(beta[:, begin] == 0, 1e-300, beta[:, begin])
        beta[:, begin] /= total
        down[:, begin] = down[:, begin + 1] + np.log(total)
    out = np.zeros(lattice.shape)
    for begin in range(n):
        for size in range(1, min(k, n - begin) + 1):
            out[:, begin, size - 1] = (alpha[:, begin] * probability[lattice[:, begin, size - 1]] * beta[:, begin + size]
                                       * np.exp(scale[:, begin] + down[:, begin + size] - scale[:, n]))
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    probability: np.ndarray  # [piece, language], with the rows for unknown letters and for no piece
    vocabulary: str


def by_length(words: list[str]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups


class Scorer:
    """Log-probabilities of texts, with the scores of words kept per worker."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces(model.vocabulary)
        self._word: dict[str, int] = {}
        self._logs = np.zeros((1024, len(model.languages)))

    def _forget_words(self) -> None:
        """The older half of the words goes."""
        kept = list(self._word)[len(self._word) // 2:]
        self._logs = np.concatenate([self._logs[[self._word[w] for w in kept]], np.zeros((1024, self._logs.shape[1]))])
        self._word = dict(zip(kept, range(len(kept)), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        first = len(self._word)
        while first + len(words) > len(self._logs):
            self._logs = np.concatenate([self._logs, np.zeros_like(self._logs)])
        self._word.update(zip(words, range(first, first + len(words)), strict=True))
        for n, group in by_length(words).items():
            step = max(1, 200_000 // (n * min(n, self.pieces.longest)))
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self._logs[[self._word[w] for w in part]] = word_logs(self.pieces.lattice(part), self.model.probability)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of chunks, and which of them hold letters."""
        runs = [["▁" + r for r in LETTERS.findall(c.lower())] for c in chunks]
        if len(self._word) > CACHE:
            self._forget_words()
        new = sorted({r for x in runs for r in x}.difference(self._word))
        if new:
            self._learn_words(new)
        out, sizes = np.zeros((len(chunks), self._logs.shape[1])), np.fromiter(map(len, runs), np.int64, len(runs))
        if sizes.any():
            np.add.at(out, np.repeat(np.arange(len(chunks)), sizes), self._logs[[self._word[r] for x in runs for r in x]])
        return out, sizes > 0

    def scores(self, texts: pa.Array) -> Iterator[np.ndarray | None]:
        """Log-probability per language of each text, None without letters."""
        for begin, end in slices(texts):
            chunks, codes, offsets = coded(texts.slice(begin, end - begin))
            logs, letters = self._chunks(chunks)
            for a, b in zip(offsets, offsets[1:], strict=False):
                yield logs[codes[a:b]].sum(axis=0) if letters[codes[a:b]].any() else None


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
    rows = [(lang, "▁" + w, n) for lang, c in counts.items() for w, n in c.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "word", "n"])


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, where = pieces(model.vocabulary), {x: i for i, x in enumerate(model.languages)}
        total = np.zeros((len(where), len(known.number)))
        for batch in batches:
            counts: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(lang, {})[word] = n
            for lang, words in counts.items():
                column = model.probability[:, where[lang]]
                for n, group in by_length(list(words)).items():
                    step = max(1, 200_000 // (n * min(n, known.longest)))
                    for i in range(0, len(group), step):
                        part = group[i:i + step]
                        lattice = known.lattice(part)
                        share = expected_counts(lattice, column) * np.array([words[w] for w in part])[:, None, None]
                        real = lattice >= 0
                        total[where[lang]] += np.bincount(lattice[real], share[real], total.shape[1])
        at, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[at, piece])],
                                         ["language", "piece", "n"])
    return run


def learn(labelled: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model from (doc_id, text, lang) rows with a language. The driver sees one row per language and piece."""
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = tuple(sorted(counts))
    size = len(pieces(vocabulary).number)
    if not languages:
        return Model((), np.zeros((size + 2, 0)), vocabulary)
    order = F.xxhash64("doc_id", "text")
    share = F.lit(0.0)
    for lang in languages:  # twice the wanted number survives the first cut
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_language / counts[lang] + 1e-3))).otherwise(share)
    few = labelled.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 30)) < share * (1 << 30))
    few = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))) \
        .filter(F.col("_rank") <= per_language)
    words = cut_lineage(few.select("lang", "text").mapInArrow(_word_counts, schema("lang string, word string, n long"))
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    words = words.repartition(task_count(labelled.sparkSession), "lang", "word")  # bounded, few bytes and much to compute
    start = np.full((size, len(languages)), 1.0 / size)
    model = _with_rows(languages, start, vocabulary)
    for _ in range(rounds):
        found = words.mapInArrow(_expect(model), schema("language int, piece int, n double")).groupBy("language", "piece") \
            .agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros_like(start)
        expected[found["piece"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
        expected += 0.1
        model = _with_rows(languages, expected / expected.sum(axis=0), vocabulary)
    return model


def _with_rows(languages: tuple[str, ...], probability: np.ndarray, vocabulary: str) -> Model:
    n = probability.shape[1]
    return Model(languages, np.vstack([probability, np.full((1, n), UNKNOWN), np.zeros((1, n))]), vocabulary)


def _predict(model: Model, kept: bool):
    """`kept`: the rows are one struct column; otherwise the text is the last column and the others go on."""
    mark = blake2b(model.probability.tobytes() + repr((model.languages, model.vocabulary)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", mark), lambda: Scorer(model))
        for batch in batches:
            names, shares = [], []
            texts = batch.column(0).field("text") if kept else batch.column(batch.num_columns - 1)
            carried = batch.columns[:1] if kept else batch.columns[:-1]
            for logs in scorer.scores(texts) if model.languages else [None] * len(texts):
                if logs is None:
                    names.append(UNDETERMINED), shares.append(0.0)
                    continue
                part = np.exp(logs - logs.max())
                names.append(model.languages[int(part.argmax())]), shares.append(float(part.max() / part.sum()))
            yield pa.RecordBatch.from_arrays([*carried, pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                                             [*batch.schema.names[:len(carried)], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The `keep` columns, lang_pred and score of every text; only the text decides."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_predict(model, False), schema(f"{kinds}, lang_pred string, score double"))


def held_out(doc_id: str = "doc_id"):
    """One id in three, by checksum, is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def drop_rejected(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The documents with a language, with their columns: not `und`, and one language has at least `least` of the
    probability. Without any labelled text only texts without letters go."""
    if training_rows(docs).isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    model = learn(training_rows(docs), vocabulary)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kind = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(_predict(model, True), kind)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("_row.*")
