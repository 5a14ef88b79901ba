import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assetweave.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", "a   b", "a\n \nb", "  x", "x ", "a \nb", "é\xa0ö\x1c z", "<|endoftext|> hi", "it's  I'LL\t\tgo 12345 !!!", "ß日本語 😀 ​",
         "\r\n\r\n a", "\x00 \x85 b", "x" * 5000]


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_tokenizer():
    want, got = reference(), tokens.encoder(PATH).encode
    made = random.Random(1)
    mixed = ["".join(made.choice(["a", "B", " ", "  ", "\n", "é", "1", "!", "'s", "\t", "日"]) for _ in range(made.randrange(60))) for _ in range(400)]
    for text in TEXTS + mixed:
        assert got(text).tolist() == want(text), repr(text)


def test_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    want, got = reference(), tokens.Encoder(PATH).encode
    for text in ["a b c d e", "b c f g h", "a b c d e f"]:
        assert got(text).tolist() == want(text)


def check(rows, docs, length):
    want, pieces, sequences = reference(), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs.items():
        ids = [i for _, part, _ in sorted(pieces.pop(doc_id)) for i in part]
        assert ids == [*want(text), 0]
    assert not pieces
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    return sequences


@pytest.mark.parametrize("length, shard", [(64, 8), (1024, 512), (16, 3)])
def test_every_id_lies_in_one_piece(spark, length, shard):
    made = random.Random(2)
    vocabulary = [["river", "stone", "water", "boat"], ["tax", "law", "court", "judge"], ["été", "mer", "soleil"]]
    docs = {i: " ".join(made.choice(made.choice(vocabulary)) for _ in range(made.choice([0, 1, 5, 30, 300]))) for i in range(120)}
    docs |= {1000: None, 1001: "", 1002: "x " * 4000}
    df = spark.createDataFrame([(i, t, "extra") for i, t in docs.items()], "doc_id long, text string, ids string")
    check(packing.pack(df, PATH, length, shard).collect(), docs, length)


def test_neighbours_are_lexical():
    """A seed is filled with texts of its own words."""
    made = np.random.default_rng(0)
    pieces = [made.integers(1 + 50 * (i % 4), 50 + 50 * (i % 4), 16).astype(np.uint16) for i in range(40)]
    idf = np.ones(packing.IDS)
    items = [(i, 16, 0, p) for i, p in enumerate(pieces)]
    windows, rest = packing._fill(items, idf, 16.0, 64)
    assert sum(len(x[3]) for w in windows for x in w) + sum(len(x[3]) for x in rest) == 640
    same = sum(len({x[0] % 4 for x in w}) == 1 for w in windows)
    assert same >= len(windows) - 2


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sorted((str(r.doc_id), sum(1 for _ in r.ids) // 4) for r in rows if r.start == 0) and sum(r.length for r in rows) == 3 + 3 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_length_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1000)
