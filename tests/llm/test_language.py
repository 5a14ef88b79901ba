import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from assetweave.llm import language as d

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": "the house and river with those people were going home through water",
         "fr": "le château était avec les élèves pour manger une très belle pomme",
         "de": "das haus und der fluß mit den leuten ging über straße zurück nach"}


def texts(n, seed=0):
    made = random.Random(seed)
    out = []
    for i in range(n):
        lang = made.choice(sorted(WORDS))
        out.append((i, " ".join(made.choice(WORDS[lang].split()) for _ in range(made.randrange(3, 30))).capitalize() + ".", lang))
    return out


def brute_word(word, probability, pieces):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = pieces.number.get(word[:k])
        p = probability[p] if p is not None else d.UNKNOWN if k == 1 else 0.0
        total += p * brute_word(word[k:], probability, pieces) if p else 0.0
    return total


def test_forward_and_expected_counts_equal_enumeration():
    pieces = d.pieces(PATH)
    made = np.random.default_rng(1)
    p = made.random(len(pieces.number)) * 0.01
    full = np.concatenate([p, [d.UNKNOWN, 0.0]])
    for word in ["▁the", "▁été", "▁日x", "▁straße"]:
        lattice = pieces.lattice([word])
        want = brute_word(word, p, pieces)
        assert math.isclose(d.forward(lattice, full[:, None])[1][0, -1, 0], math.log(want), rel_tol=1e-9)
        share = d.expected_counts(lattice, full)[0]
        # every letter lies in one piece of a segmentation
        cover = np.zeros(len(word))
        for i in range(len(word)):
            for k in range(share.shape[1]):
                cover[i:i + k + 1] += share[i, k]
        assert np.allclose(cover, 1)


def test_scores_of_texts_are_sums_over_words():
    pieces = d.pieces(PATH)
    made = np.random.default_rng(2)
    p = made.random((len(pieces.number), 2)) * 0.01
    model = d._with_rows(("a", "b"), p, PATH)
    text = "The house, ÉTÉ the! 123"
    got = next(iter(d.Scorer(model).scores(pa.array([text]))))
    for k in range(2):
        want = sum(math.log(brute_word("▁" + w, p[:, k], pieces)) for w in ["the", "house", "été", "the"])
        assert math.isclose(got[k], want, rel_tol=1e-9)


def test_held_out_accuracy_and_special_texts(spark, documents):
    rows = texts(300)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !! --", "fr"), (1003, "日本語", None), (1004, "das " * 50_000, None),
           (1005, "x" * 20_000, None), (None, "the house", None), (1, rows[1][1], rows[1][2])]
    docs = documents(*rows, *odd).withColumn("score", docs_lit("mine")).withColumn("lang_pred", docs_lit("mine"))
    model = d.learn(d.training_rows(docs), PATH)
    got = d.predict(docs.withColumn("held_out", d.held_out()), model, "doc_id", "held_out").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 308 and model.languages == ("de", "en", "fr")
    out = [r for r in rows if by_id[r[0]].held_out]
    assert out and sum(by_id[i].lang_pred == lang for i, _, lang in out) / len(out) >= 0.98
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1004].lang_pred == "de" and by_id[1005].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got)


def docs_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_labels_of_held_out_rows_are_not_used(documents):
    import zlib
    kept = {r.doc_id for r in d.training_rows(documents(*texts(60))).collect()}
    assert kept == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_no_labels_and_empty_table(spark, documents):
    docs = documents((1, "hello"), (2, "!!"), (3, None))
    model = d.learn(d.training_rows(docs), PATH)
    assert {r.lang_pred for r in d.predict(docs, model, "doc_id").collect()} == {"und"}
    assert [r.doc_id for r in d.drop_rejected(docs, PATH).collect()] == [1]
    assert d.predict(documents(), model, "doc_id").count() == 0
    assert d.drop_rejected(documents(), PATH).count() == 0


def test_filter_keeps_columns_and_clean_texts(documents):
    rows = texts(60)
    docs = documents(*rows, (1000, None), (1001, "?!")).withColumn("score", docs_lit(1)).withColumn("lang_pred", docs_lit("q"))
    kept = d.drop_rejected(docs, PATH)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))


def test_long_runs_are_learned(documents):
    """A language without spaces, all of whose words are long."""
    docs = documents(*[(i, "wasserstraße" * 9, "de") for i in range(9)], *[(100 + i, "the house", "en") for i in range(9)])
    model = d.learn(d.training_rows(docs), PATH)
    held = d.pieces(PATH).number
    at = model.languages.index("de")
    real = model.probability[:len(held), at]
    assert real.max() > 100 * np.median(real)


def test_words_without_scales_equal_the_forward_pass():
    pieces = d.pieces(PATH)
    made = np.random.default_rng(3)
    full = np.concatenate([made.random((len(pieces.number), 3)) * 1e-7 + 1e-9, [[d.UNKNOWN] * 3, [0.0] * 3]])
    for n in (1, 5, d.UNSCALED, d.UNSCALED + 1):
        words = ["".join(made.choice(list("▁aeinrst日ß"), n)) for _ in range(20)]
        lattice = pieces.lattice(words)
        assert np.allclose(d.word_logs(lattice, full), d.forward(lattice, full)[1][:, n], rtol=1e-9)


def test_forgotten_words_change_no_score(monkeypatch):
    from assetweave.llm import words
    made = random.Random(4)
    pieces = d.pieces(PATH)
    model = d._with_rows(("a", "b"), np.random.default_rng(2).random((len(pieces.number), 2)) * 0.01, PATH)
    some = pa.array([" ".join("".join(made.choice("abcdef.") for _ in range(made.randrange(1, 6))) for _ in range(40)) for _ in range(60)])
    want = np.array(list(d.Scorer(model).scores(some)))
    monkeypatch.setattr(d, "CACHE", 50)
    monkeypatch.setattr(words.slices, "__defaults__", (100,))
    scorer = d.Scorer(model)
    assert np.allclose(np.array(list(scorer.scores(some))), want)
    assert len(scorer._word) < 400


def test_texts_in_slices_equal_one_by_one(monkeypatch):
    from assetweave.llm import words
    texts = ["a B  c", None, "", " \t\n\u3000", "x\x1cy\u2028z", "Éé!? --", "word " * 50, "😀 ok"] * 3
    column = pa.array(["skipped", *texts]).slice(1)
    for size in (1, 30, 10**6):
        monkeypatch.setattr(words.slices, "__defaults__", (size,))
        assert [r for a, b in words.slices(column) for r in range(a, b)] == list(range(len(texts)))
        got = list(words.text_hashes(column))
        want = [[h for c in (t or "").split() if (h := words._hash(c))] for t in texts]
        assert [g.tolist() for g in got] == want


def test_a_worker_keeps_one_thing_at_a_time():
    from assetweave.llm import held, tokens
    first = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")) is first
    d.pieces(PATH)
    assert held._KEPT[0] == ("pieces", PATH)
