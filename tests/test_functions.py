import random
from difflib import SequenceMatcher
from urllib.parse import urljoin

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetweave.functions import names, similarity, text, urls
from assetweave.functions.similarity import COMPARABLE, ratio_bound, sequence_ratio, subsequence_bound


def test_clean_name(one):
    cases = {
        "PHILIPS HEALTHCARE***USE V#79***": "PHILIPS HEALTHCARE", "COMPANY (USE CODE 123)": "COMPANY", "***789***": "789",
        "  ***COMPANY***USE V#1***  ": "COMPANY", "NAME  (USE 123)***": "NAME", "***NAME***USE V#1***(USE 2)***": "NAME",
        "company***use v#1***": "company", "BJÖRK ÅSTRÖM***USE V#1***": "BJÖRK ÅSTRÖM", "\tNAME\t": "NAME", "***": "", "  ": "",
        "A    B ": "A B"}
    assert one(list(cases), names.clean_name) == list(cases.values())
    assert one([None], names.clean_name) == [None]


def test_clean_name_is_idempotent_unless_a_removal_exposes_another_pattern(one):
    plain = ["***A***USE V#1***", "B (USE 2)", "C", " D  E "]
    once = one(plain, names.clean_name)
    assert one(once, names.clean_name) == once
    nested = one(["X(USE***USE V#1***"], names.clean_name)  # the parenthesis never closes
    assert nested == ["X(USE"]


def test_name_issues(one):
    got = one(["***A***USE V#1***", "B (use x)", "clean", None], names.name_issues)
    assert got[:3] == [["use_code_suffix", "leading_asterisks", "trailing_asterisks"], ["use_code_parens"], []]


def test_strip_suffixes(one):
    assert one(["Zeiss Corporation", "Acme Company"], lambda c: names.strip_suffixes(c)) == ["zeissoration", "acmempany"]
    assert one(["The Acme Inc", "Acme Company", "Acme Co Ltd"], lambda c: names.strip_suffixes(c, "anchored")) == \
        ["acme", "acme", "acme co"]
    with pytest.raises(ValueError):
        names.strip_suffixes(F.col("v"), "other")


def test_normalize_file_name(one):
    got = one(["Manual_v1.pdf", "Manual_v2.PDF", "Manual_updated.pdf", "Document_2024_final.pdf", "a..pdf", ".pdf", "X (2) - new.pdf", None],
              names.normalize_file_name)
    assert got == ["manual", "manual", "manual", "document", "a", "pdf", "x", ""]


def test_doc_priority(one):
    files = ["User_Manual.pdf", "spec sheet.pdf", "datasheet.pdf", "carrier12.pdf", "notes.pdf", "catalog guide.pdf"]
    assert one(files, names.doc_category) == ["high_priority", "medium_priority", "noise", "noise", "unknown", "high_priority"]
    assert one(files, names.doc_priority) == [100, 50, 0, 0, 25, 100]
    assert one(["datasheet", "order", "x", None, ""], names.name_sign) == [50.0, -50.0, 0.0, 0.0, 0.0]


def test_input_names(one):
    assert one(["a.xlsx", "~$a.xlsx", "a_labeled.xlsx", "b.XLS", "c.csv", ".xlsx"], names.is_input_name) == \
        [True, False, False, True, False, False]


def test_valid_url(one):
    good = ["https://a.com", "http://a.com/x", "https://a.com:8080", "HTTP://a.com"]
    bad = ["", "ftp://a.com", "http://", "http://localhost/x", "http://127.0.0.1", "javascript:alert(1)", "a.com", None, "http://[::1"]
    assert one(good + bad, urls.valid_url) == [True] * 4 + [False] * 9


def test_domains(one):
    assert one(["https://www.ancare.com/", "not_a_url", "HTTP://WWW.X.org:80/a"], urls.url_domain) == ["ancare.com", "", "x.org:80"]
    assert one(["ANCARE CORP", "AB INC"], lambda c: urls.domain_matches(F.lit("ancare.com"), c)) == [True, False]
    assert one(["http://b.com/", "http://x.b.com:1/", "http://ab.com"], lambda c: urls.allowed_domain(c, F.lit("b.com"))) == [True, True, False]


def test_resolve_url_follows_the_standard_library(one):
    hrefs = ["a.pdf", "/a/b?x=1#f", "../c", "../../../c", "./d/", "?q=2", "#top", "//other.org/x", "https://e.com/f", "", "g/../h/./i", "..", "."]
    for base in ("http://h.com/x/y/z.html?k=v#s", "https://h.com", "http://h.com/dir/", "http://h.com/a//b/c"):
        assert one(hrefs, lambda c: urls.resolve_url(F.lit(base), c)) == [urljoin(base, h) for h in hrefs], base


def test_canonical_and_file_names(one):
    assert one(["http://a/b/#x", "http://a/b?q#x"], urls.canonical_url) == ["http://a/b", "http://a/b?q"]
    assert one(["http://a/b.pdf?q=1#x"], lambda c: urls.canonical_url(c, True)) == ["http://a/b.pdf"]
    got = one(["http://a/x/m.pdf?q", "http://a/x/m", "http://a/..%2f|b.pdf", "http://a/"], urls.safe_file_name)
    assert got[:3] == ["m.pdf", "m.pdf", "%2f_b.pdf"] and got[3].startswith("document_")
    assert len(one(["http://a/" + "x" * 300], lambda c: urls.safe_file_name(c, 200))[0]) == 200


def test_sequence_ratio_and_its_bound(spark):
    words = ["", "a", "abc", "microscope stage", "stage microscope", "The quick brown fox " * 20, "fox quick " * 60]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", sequence_ratio(F.col("a"), F.col("b")).alias("r"), ratio_bound(F.col("a"), F.col("b")).alias("u")).collect()
    for r in rows:
        assert r.r == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio()) and r.r <= r.u + 1e-12


def test_search_keywords(spark):
    row = spark.createDataFrame([("The Café microscope, for A-b and x1", "Lab lab-tools")], "d string, c string").select(
        *[text.search_keywords(F.col("d"), F.col("c"), v).alias(v) for v in ("short", "full", "strict")]).first()
    assert row.short == ["café", "lab", "lab-tools", "microscope", "x1"]
    assert row.full == ["café", "lab", "lab-tools", "microscope"]
    assert row.strict == ["café", "lab", "microscope", "tools"]
    long = " ".join(f"w{i:02d}" + "x" * (i % 5) for i in range(30))
    df = spark.createDataFrame([(long,)], "d string")
    assert df.select(text.search_keywords(F.col("d")).alias("k")).first().k == sorted(set(long.split()))
    kept = df.select(text.search_keywords(F.col("d"), cap=20).alias("k")).first().k
    assert kept == sorted(set(long.split()), key=lambda w: (-len(w), w))[:20]


def test_keyword_rules(one):
    assert one(["MDF-C2156 freezer 12 volts (steel) 3 5x unit, 2021-33-44"], text.learning_tokens) == [["mdf-c2156", "freezer", "steel"]]
    verdicts = one(["ab", "psi", "analyzer", "12ab", "the", "sensor", "motor", "é" * 16], text.keyword_verdict)
    assert [(v.valid, v.reason) for v in verdicts] == [
        (False, "Too short"), (False, "Measurement unit"), (False, "Model number pattern"), (False, "Number pattern"),
        (False, "Common stopword"), (True, "Technical term"), (True, "Valid keyword"), (False, "Failed validation")]
    weights = one(["system", "spectrometer", "abc", "x" * 21], lambda c: text.keyword_weight(c, F.lit(True)))
    assert weights == pytest.approx([0.75, 1.95, 1.05, 1.2])


def test_subsequence_bound_holds_the_ratio(spark):
    made = random.Random(9)
    word = lambda most: "".join(made.choice("abcdé 😀") for _ in range(made.randrange(most)))
    pairs = [(word(40), word(most)) for _ in range(300) for most in (8, 60, 500)] + [("", ""), ("", "a"), ("a", ""), ("same", "same"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", subsequence_bound(F.col("a"), F.col("b")).alias("u"), ratio_bound(F.col("a"), F.col("b")).alias("l")).collect()

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]
    for r in got:
        if r.a is None or r.b is None:
            continue
        size = len(r.a) + len(r.b)
        most = 1.0 if not size else r.l if len(r.b) > COMPARABLE * len(r.a) else 2 * longest(r.a, r.b) / size
        assert r.u == pytest.approx(most) and r.u <= r.l
        assert SequenceMatcher(None, r.a, r.b).ratio() <= r.u + 1e-9


def test_a_text_is_indexed_once_per_batch(monkeypatch):
    built = []
    monkeypatch.setattr(SequenceMatcher, "set_seq2", (lambda old: lambda self, b: (built.append(b), old(self, b))[1])(SequenceMatcher.set_seq2))
    left, right = pd.Series(["ab", "b", "ab", "xyz"] * 3), pd.Series(["abc", "bcd"] * 6)
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)]
    built.clear()
    assert similarity._make_ratio().func(left, right).tolist() == want
    assert [b for b in built if b] == ["abc", "bcd"]
