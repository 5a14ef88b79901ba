import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import text
from assetweave.operators import (classify, cleaning, columns, filters, learning, linking, ranking, reports, resolve,
                                  similar, substring, web)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_stats(spark):
    df = spark.range(1000).select(F.lit("s").alias("src"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("***N"), "id"))
                                  .otherwise("N").alias("name"))
    assert ("s", 1000, 100) in [tuple(r) for r in cleaning.clean_stats(df, "name", "src").collect()]
    with pytest.raises(ValueError):
        cleaning.detect_issues(df, "absent")


def test_columns(spark):
    df = spark.createDataFrame([("c", "d", "v")], "`Item Code` string, `Product Title` string, Vendor string")
    assert columns.resolve_by_substring(df, "description") == "Item Code"  # first fallback in column order
    assert columns.resolve_by_substring(df, "supplier") == "Vendor"
    assert columns.resolve_by_candidates(df) == {"type": None, "code": "Item Code", "description": None, "supplier": "Vendor"}
    with pytest.raises(ValueError):
        columns.drop_by_position(df, keep=("Vendor",))


def test_labels(spark):
    cases = {"Olympus microscope for cell imaging": "Research Instrument", "Adobe software license renewal": "Software",
             "Latex gloves box of 100": "Non-Instrument", "centrifuge gloves pipette": "Research Instrument",
             "Completely unrelated thing": "Unknown", "": "Unknown", None: "Unknown", "filing system": "Research Instrument"}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    assert {r.d: r.label for r in classify.classify(df, "d").collect()} == cases
    whole = {r.d: r.label for r in classify.classify(df, "d", whole_word=True).collect()}
    assert whole["filing system"] == "Unknown"
    vendors = spark.createDataFrame([("desk", "Carl ZEISS"), ("desk", None), ("", "UPS")], "d string, v string")
    assert [r.label for r in classify.classify(vendors, "d", "v").collect()] == ["Research Instrument", "Non-Instrument", "Unknown"]
    shuffled = classify.classify(df.repartition(7), "d")
    assert rows(shuffled.na.fill("-")) == rows(classify.classify(df, "d").na.fill("-"))


def test_learning(spark):
    df = spark.createDataFrame([("digital calorimeter sensor", "Research Instrument")] * 4 + [("digital widget", "Software")],
                               "d string, label string")
    dictionary = spark.createDataFrame([("hw", "sensor")], "category string, keyword string")
    found = {(r.category, r.keyword): r.weight for r in learning.learn_candidates(df, "d", "label", dictionary).collect()}
    assert found == pytest.approx({("hw", "digital"): 6.0, ("hw", "calorimeter"): 4 * 1.5 * 1.3, ("sw", "digital"): 1.0, ("sw", "widget"): 1.0})
    decided = learning.promote(learning.learn_candidates(df, "d", "label", dictionary), dictionary, 5)
    assert rows(decided.select("keyword", "promoted", "reason")) == [
        ("calorimeter", False, "Model number pattern"), ("digital", False, "Model number pattern")]


def test_substring_pairs_equals_brute_force(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcé9") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    needles, hays = sorted(set(pool[:120])), sorted(set(pool[120:]))
    got = substring.substring_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"),
                                    spark.createDataFrame([(h,) for h in hays], "hay string"))
    assert rows(got) == sorted((n, h) for n in needles for h in hays if n in h)


def _reference_entity(name, targets):
    low = name.lower()

    def bare(x):
        x = x.lower()
        for s in rules.COMPANY_SUFFIXES:
            if x.endswith(s):
                x = x[:-len(s)].strip()
                break
        return x[4:].strip() if x.startswith("the ") else x
    tests = [("exact", lambda t: low == t.lower()), ("containment", lambda t: low in t.lower() or t.lower() in low),
             ("words", lambda t: len(set(low.split()) & set(t.lower().split())) >= max(1, len(set(low.split())) * 0.5)),
             ("cleaned", lambda t: bare(name) == bare(t))]
    for strategy, test in tests:
        hit = [t for t in sorted(targets) if test(t)]
        if hit:
            return name, hit[0], strategy
    return None


def test_resolve_entities_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["carl", "zeiss", "micro", "imaging", "lab", "tools", "the", "inc", "co", "ltd", "acme", "zen", "north"]
    def name():
        return " ".join(rng.choice(words).title() for _ in range(rng.randint(1, 5)))
    names, targets = sorted({name() for _ in range(150)} | {"The Quark Inc", "Zz"}), sorted({name() for _ in range(60)} | {"quark ltd"})
    got = resolve.resolve_entities(spark.createDataFrame([(n,) for n in names] + [(" ",)], "name string"),
                                   spark.createDataFrame([(t,) for t in targets], "target string"))
    assert rows(got) == sorted(filter(None, (_reference_entity(n, targets) for n in names)))


def test_containment_of_names_that_many_share(spark):
    names = [f"acme {i}" for i in range(400)] + ["zen", "q", "ACME"]
    targets = [f"zen {i}" for i in range(400)] + ["acme", "Acme 3", "zz"]
    got = resolve.resolve_entities(spark.createDataFrame([(n,) for n in names], "name string"),
                                   spark.createDataFrame([(t,) for t in targets], "target string"), ("exact", "containment"))
    assert rows(got) == sorted(filter(None, (_reference_entity(n, targets) for n in names)))
    plan = resolve._containment(spark.createDataFrame([(n, n.lower()) for n in names], "name string, low string"),
                                spark.createDataFrame([(t, t.lower()) for t in targets], "target string, tlow string"))
    assert plan.count() == 402


def _words_like(rng, letters, lengths, n):
    made = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)]
    for word in made[:n // 3]:  # and some with a few changes
        at = rng.randrange(len(word))
        made += [word[:at] + rng.choice(letters) + word[at + 1:], word[:at] + word[at + 1:] or "a", word[at:] + word[:at]]
    return sorted(set(made))


@pytest.mark.parametrize("letters, lengths, cutoff", [
    ("abcdefg", range(3, 10), 0.5), ("abcdefghijklmnop", range(1, 15), 0.6), ("abcdé😀 ", range(2, 60, 7), 0.7), ("ab", range(1, 30), 0.9),
    ("abcdefghij", range(2, 9), 1.0), ("abcdef", [2, 3, 50], 0.1)])
def test_suggest_similar_equals_brute_force(spark, letters, lengths, cutoff):
    rng = random.Random(7)
    names, targets = _words_like(rng, letters, lengths, 40), _words_like(rng, letters, lengths, 50)
    got = resolve.suggest_similar(spark.createDataFrame([(n,) for n in [*names, "", None]], "name string"),
                                  spark.createDataFrame([(t,) for t in [*targets, "", None]], "target string"), cutoff, 2)
    expected = []
    for n in names:
        scored = sorted(((-SequenceMatcher(None, n, t).ratio(), t) for t in targets))
        expected += [(n, i + 1, t, pytest.approx(-s)) for i, (s, t) in enumerate(scored[:2]) if -s >= cutoff]
    assert rows(got) == sorted(expected, key=lambda r: r[:3]) and expected


def test_suggest_similar_folds_case_and_takes_empty_tables(spark):
    names, targets = spark.createDataFrame([("ACME Labs",)], "name string"), spark.createDataFrame([("acme labs",), ("Acme LABS",)], "target string")
    assert rows(resolve.suggest_similar(names, targets, 1.0, 5)) == [("ACME Labs", 1, "Acme LABS", 1.0), ("ACME Labs", 2, "acme labs", 1.0)]
    assert rows(resolve.suggest_similar(names.limit(0), targets)) == rows(resolve.suggest_similar(names, targets.limit(0))) == []


def test_signatures_leave_few_candidates(spark):
    rng = random.Random(3)
    made = [["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(6, 12))) for _ in range(400)] for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in sorted(set(m))], "low string") for m in made)
    assert similar.candidate_pairs(left, right, 0.8).count() < 400 * 400 / 200


def test_url_routing(spark):
    hits = spark.createDataFrame([
        ("ANCARE CORP", "d", 1, "https://www.ancare.com/"), ("ANCARE CORP", "b", 1, "https://ancare.com/about"),
        ("ANCARE CORP", "b", 2, "https://www.amazon.com/ancare"), ("SOLO", "d", 1, "not_a_url")],
        "supplier string, engine string, pos int, url string")
    suppliers = spark.createDataFrame([("ANCARE CORP",), ("SOLO",), ("NONE",)], "supplier string")
    best = resolve.route_by_confidence(resolve.pick_best_url(suppliers, hits, ("d", "b")))
    assert rows(best) == [("ANCARE CORP", "https://www.ancare.com/", 110, "Auto-Added"), ("NONE", "", 0, "Pending Review"),
                          ("SOLO", "", 0, "Pending Review")]


def test_master_and_append(spark):
    df = spark.createDataFrame([(1, " zeiss ", "a"), (2, "ZEISS", " b "), (3, "X", None), (4, None, "c"), (5, "Y", "")],
                               "pos int, name string, site string")
    assert rows(resolve.load_master(df, "name", "site", "pos")) == [("ZEISS", "b")]
    new = resolve.append_if_absent(spark.createDataFrame([("A",)], "k string"),
                                   spark.createDataFrame([("A", 1), ("B", 3), ("B", 2)], "k string, n int"), "k", "n")
    assert rows(new) == [("B", 2)]
    assert resolve.load_supplier_pairs(df, "absent", "site").count() == 0


def _score(rule, description, doc, file_name, keywords):
    low, body, name = description.lower(), doc.lower(), file_name.lower()
    cov = sum(k in body for k in keywords) / len(keywords)
    ratio = SequenceMatcher(None, low, body if rule.sample is None else body[:rule.sample]).ratio()
    if rule.kind == "named":
        import re
        if len(doc.strip()) < rule.min_text:
            return 0.0
        said = re.findall(r"\w+", low)
        score = cov * 60 + ratio * 25 + sum(len(w) > 3 and w in name for w in said) / len(said) * 15
        score = max(0, score - (15 if any(p in name for p in rules.MARKETING_NAME_PARTS) else 0))
        return min(100, score + (10 if any(p in name for p in rules.TECHNICAL_NAME_PARTS) else 0))
    if rule.kind == "plain":
        score = min(100, cov * rule.keyword_weight + ratio * rule.ratio_weight)
        if rule.name_boost:
            score = min(100, score + (15 if "manual" in name else 0))
        return score
    import re
    mine = re.findall(r"\b[A-Z0-9]{3,}\b", low.upper())
    structure = len(set(mine) & set(re.findall(r"\b[A-Z0-9]{3,}\b", body.upper()))) / len(mine) * 100 if mine else 0
    over = len(set(low.split()) & set(body.split())) / len(set(low.split())) * 100
    score = cov * 40 + ratio * 30 + structure * 0.2 + over * 0.1
    return min(100, score * (1.3 if any(len(p.strip()) > 5 and p.strip() in body for p in low.split(",")) else 1))


@pytest.mark.parametrize("rule, threshold, by", [
    (linking.NAMED, 20, "supplier"), (linking.NAMED, 55, None), (linking.PLAIN, 35, None), (linking.BOOSTED, 50, None),
    (linking.FOUR_SIGNAL, 80, None), (linking.FOUR_SIGNAL, 30, "supplier"), (linking.EVEN, 55, None), (linking.PLAIN, 5, "supplier"),
    (linking.NAMED, 40, "supplier"), (linking.NAMED, 30, "supplier"), (linking.BOOSTED, 12, "supplier"), (linking.EVEN, 45, "supplier"),
    (linking.NAMED.limited(sample=2000, min_text=800), 20, "supplier"), (linking.PLAIN.limited(sample=30, keyword_cap=3), 40, None)])
def test_link_equals_brute_force(spark, rule, threshold, by):
    rng = random.Random(11)
    vocabulary = ["microscope", "scope", "pump", "valve", "flow", "cell", "x200", "abc", "led", "optics", "stage", "é-lens", "&&"]
    def phrase(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(4) + ", " + phrase(2), rng.choice(["Lab-x &&", "", "Optics"]), f"S{i % 3}") for i in range(12)]
    docs = [(d, (phrase(rng.choice([3, 40, 200])) + " filler text ") * 3, rng.choice(["scope manual.pdf", "price.pdf", "notes.pdf"]), f" s{d % 3}")
            for d in range(30)]
    left = spark.createDataFrame(items, "item_id int, description string, category string, supplier string")
    right = spark.createDataFrame(docs, "doc_id int, text string, file_name string, supplier string")
    kws = {r.item_id: r.k for r in left.select("item_id", text.search_keywords(F.col("description"), F.col("category"), rule.keywords, rule.keyword_cap).alias("k")).collect()}
    expected = {}
    for i, description, _, supplier in items:
        for d, body, name, folder in docs:
            if by is None or supplier.lower() == folder.strip():
                score = _score(rule, description, body, name, kws[i])
                if score >= threshold:
                    expected[i, d] = score
    got = {(r.item_id, r.doc_id): r.score for r in linking.link(left, right, threshold, rule, by).collect()}
    assert got == pytest.approx(expected) and expected


def test_link_refuses_all_pairs(spark):
    df = spark.createDataFrame([(1, "a", "s", "f", "t")], "item_id int, description string, supplier string, file_name string, text string")
    with pytest.raises(ValueError):
        linking.link(df, df.withColumnRenamed("item_id", "doc_id"), 40, linking.NAMED, by=None)


def test_prioritize_and_dedup(spark):
    docs = spark.createDataFrame([(i, "s", f"manual {i:02d}.pdf") for i in range(9)] + [(20 + i, "s", f"x{i}.pdf") for i in range(4)]
                                 + [(40, "s", "brochure.pdf")], "doc_id int, supplier string, file_name string")
    assert sorted(r.doc_id for r in ranking.prioritize(docs).collect()) == [0, 1, 2, 3, 4, 20, 21]
    found = spark.createDataFrame([(1, "Manual_v1.pdf", 75.0), (1, "Manual_v2.pdf", 85.0), (1, "Manual_updated.pdf", 80.0), (1, "Other.pdf", 1.0)],
                                  "item_id int, file_name string, score double")
    assert rows(ranking.dedup_matches(found).select("file_key", "score")) == [("manual", 85.0), ("other", 1.0)]


def test_number_rows_and_budget(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v")).repartition(5)
    got = ranking.number_rows(df, "v").collect()
    assert all(r.number == r.v + 1 and r.total == 100 for r in got) and len(got) == 100
    parts = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, ""), (1, 2, "bbbb"), (1, 3, "cccc"), (1, 6, "late")], "k int, p int, text string")
    assert rows(ranking.text_budget(parts, "k", "p", max_parts=5, max_chars=6)) == [(1, "aaaa bbbb")]


def test_links(spark):
    robots = spark.createDataFrame([("https://h.com/robots.txt", "User-agent: *\nSitemap: /a.xml\nSITEMAP: https://x.org/b.xml\n")], "base string, text string")
    assert [r.sitemap for r in web.sitemaps_from_robots(robots).orderBy("pos").collect()] == ["https://h.com/a.xml", "https://x.org/b.xml"]
    html = """<a href='/a.pdf'>1</a> <A class=x HREF="b.PDF">2</a><a href=c.pdf>3</a><a href="page.html?x=1&amp;y=2">4</a><a href="#t">5</a>
        <a href="mailto:x@y">6</a><a href="https://other.com/z.pdf">7</a><!-- <a href="/no.pdf"> --><script>"<a href='/no'>"</script><a data-href="/no">8</a>"""
    got = web.extract_links(spark.createDataFrame([(1, "http://example.com/d/", html)], "page_id int, url string, html string"))
    assert [(r.dst, r.kind) for r in got.orderBy("pos").collect()] == [
        ("http://example.com/a.pdf", "document"), ("http://example.com/d/b.PDF", "document"), ("http://example.com/d/c.pdf", "document"),
        ("http://example.com/d/page.html?x=1&y=2", "page")]


def test_reachable(spark):
    edges = spark.createDataFrame([("http://a/", i, f"http://a/{i}", "page") for i in range(15)]
                                  + [("http://a/0", 0, "http://a/", "page"), ("http://a/0", 1, "http://a/deep", "page"), ("http://a/deep", 0, "http://a/deeper", "page")],
                                  "src string, pos int, dst string, kind string")
    seeds = spark.createDataFrame([("a", "http://a/")], "site string, url string")
    got = {r.url: r.depth for r in web.reachable(edges, seeds, per_page=10, per_site=50).collect()}
    assert got == {"http://a/": 0, **{f"http://a/{i}": 1 for i in range(10)}, "http://a/deep": 2}
    assert web.reachable(edges, seeds, max_depth=3).count() == 18 and web.reachable(edges, seeds).count() == 17
    assert web.reachable(edges, seeds, per_site=4).count() == 4


def test_reports_without_matches(spark):
    items = spark.createDataFrame([(1, "d")], "item_id int, description string")
    none = spark.createDataFrame([], "item_id int, supplier string, file_name string, score double, text string")
    summary = reports.match_summary(items, none)
    assert rows(summary) == [(1, 0, 1, 0, 0.0, 0.0)]
    assert sum(r.matches for r in reports.score_histogram(none).collect()) == 0
    assert {r.code for r in reports.recommendations(summary, reports.score_range(none)).collect()} == {"low_match_rate", "low_average_score"}
    assert rows(reports.match_detail(items, none)) == [(1, "d", "No matches", "", 0.0, "")]


def test_due_for_rescan(spark):
    sites = spark.createDataFrame([("new",), ("old",), ("fresh",), ("odd",)], "supplier string")
    state = spark.createDataFrame([("old", "2024-01-01T00:00:00"), ("fresh", "2024-01-09T00:00:01.5"), ("odd", "?")], "supplier string, last_seen string")
    due = filters.due_for_rescan(sites, state, F.lit("2024-01-16 00:00:00").cast("timestamp"))
    assert rows(due) == [("new",), ("odd",), ("old",)]


def test_link_with_a_threshold_that_no_item_can_reach(spark):
    items = spark.createDataFrame([(1, "pump valve", "s"), (2, "flow cell led", "s")], "item_id int, description string, supplier string")
    docs = spark.createDataFrame([(1, "f.pdf", "pump valve " * 90, "s")], "doc_id int, file_name string, text string, supplier string")
    assert linking.link(items, docs, 99).count() == 0


ITEMS = "item_id int, description string, supplier string"
DOCS = "doc_id int, file_name string, text string, supplier string"


def flow_fixture(spark):
    body = "zeiss axio imager microscope with stage and optics"
    docs = [(1, "Manual_v1.pdf", body, "Zeiss"), (2, "Manual_v2.pdf", body + " more", "Zeiss"), (3, "guide.pdf", "olympus cx23 microscope manual", "Olympus")]
    items = [(1, "Axio imager microscope", "ZEISS"), (2, "axio imager stage", "Zeiss Group Ltd"), (3, "cx23 microscope", "nobody at all"),
             (4, "axio imager optics", "House brand"), (5, "unknown thing", "nobody at all")]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS), spark.createDataFrame(
        [("House brand", "zeiss")], "supplier string, folder string")


def test_items_are_routed_and_fall_back(spark):
    items, docs, aliases = flow_fixture(spark)
    routed = {r.item_id: (r.folder, r.strategy) for r in linking.route_items(items, docs, aliases).collect()}
    assert routed == {1: ("Zeiss", "exact"), 2: ("Zeiss", "containment"), 3: (None, None), 4: ("Zeiss", "exact"), 5: (None, None)}
    got = {(r.item_id, r.file_key): (r.doc_id, r.fallback) for r in linking.link_items(items, docs, 60, aliases=aliases).collect()}
    # one of the two manuals stays; the item without a folder finds its document among all
    assert set(got) == {(1, "manual"), (2, "manual"), (3, "guide"), (4, "manual")}
    assert got[3, "guide"] == (3, True) and not got[1, "manual"][1]


def test_master_folders(spark):
    items, docs, _ = flow_fixture(spark)
    typed = items.withColumn("kind", F.when(F.col("item_id") == 3, "Instrument").otherwise("Software"))
    master = spark.createDataFrame([(" OLYMPUS ",), ("House brand",)], "supplier string")
    aliases = spark.createDataFrame([("House brand", "zeiss")], "supplier string, folder string")
    assert {r.doc_id for r in linking.link_master_folders(items, docs, master, 60).collect()} == {3}
    assert {r.doc_id for r in linking.link_master_folders(items, docs, master, 60, aliases=aliases).collect()} == {1, 2, 3}
    assert {r.item_id for r in linking.link_master_folders(typed, docs, master, 60, type_column="kind").collect()} == {3}


def test_clean_status_and_ready_keywords(spark):
    df = spark.createDataFrame([("a", "***X***"), ("b", "Y")], "src string, name string")
    sources = spark.createDataFrame([("a", None), ("b", None), ("c", "unreadable"), ("d", None)], "src string, error string")
    got = {r.src: (r.rows_total, r.status) for r in cleaning.clean_status(sources, cleaning.clean_stats(df, "name", "src"), "src").collect()}
    assert got == {"a": (1, "cleaned"), "b": (1, "unchanged"), "c": (0, "failed"), "d": (0, "failed")}
    candidates = spark.createDataFrame([("hw", "pump", 6.0), ("hw", "valve", 4.0)], "category string, keyword string, weight double")
    assert rows(learning.ready_candidates(candidates)) == [("hw", "pump", 6.0)]


def test_hits_are_counted_without_reading_texts_of_hopeless_pairs(spark):
    """Compound and rare keywords, words longer than a part, repeated and null ids."""
    items = spark.createDataFrame([(1, "alpha beta gamma delta", "x-ray"), (2, "omega", ""), (2, "omega", ""), (3, "beta tail", ""), (None, "omega", "")],
                                  "item_id int, description string, category string")
    far = "q" * 254 + "omega" + "z" * 700 + "tail"
    texts = [(1, "Alphabet, beta\ngammas."), (2, "delta"), (3, "x-ray alpha (beta)"), (4, "xx ray alpha beta"), (5, far), (5, far), (6, None), (None, "omega"), (7, "x ray beta-tail")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = []
    for i in items.collect():
        kw = set(i.description.split()) | set(i.category.split())
        for d in docs.collect():
            hits = sum(k in (d.text or "").lower() for k in kw)
            if None not in (i.item_id, d.doc_id) and hits >= 0.6 * len(kw) - 1e-9:
                want.append((i.item_id, d.doc_id, hits))
    got = linking.coverage_links(items, docs, 0.6).select("item_id", "doc_id", "hits")
    assert rows(got) == sorted(want) and (2, 5, 1) in want and (1, 3, 3) in want and (1, 4, 3) not in want
    numbered = spark.createDataFrame([(0, ["alpha", "beta", "delta"], [(0, 2)])], "_item int, _keywords array<string>, _needs array<struct<class int, need int>>")
    hopeless = spark.createDataFrame([(0, "delta", 0), (1, "alpha delta", 0)], "_doc int, _text string, _class int")
    assert rows(linking.candidate_pairs(numbered, hopeless, [])) == [(0, 1, 2)]


def test_texts_move_once_whatever_the_blocks(spark, monkeypatch):
    """Blocks of two items and a task per document give the same hits; besides the items, and the texts of a scored link, no table is written."""
    monkeypatch.setattr(linking, "BLOCK", 2)
    monkeypatch.setattr(linking, "BUCKET", 1)
    made, syllables = random.Random(4), ["on", "tion", "pump", "x200", "é", "flow", "a1"]
    said = lambda n: " ".join("".join(made.choice(syllables) for _ in range(made.randrange(1, 4))) for _ in range(n))
    items = [(i, said(5), made.choice(["", "Lab-on", "the-tion", "&&"]), f"s{i % 3}") for i in range(9)] + [(9, "pump", "", None)]
    docs = [(d, made.choice([said(12), said(3).upper() + ",", said(200), "lab-on && " + said(4)]), f"{d}.pdf", f"S{d % 4}") for d in range(25)] \
        + [(25, None, "n.pdf", "s0"), (26, "", "e.pdf", None)]
    left = spark.createDataFrame(items, "item_id int, description string, category string, supplier string")
    right = spark.createDataFrame(docs, "doc_id int, text string, file_name string, supplier string")
    kws = {r.item_id: r.k for r in left.select("item_id", text.search_keywords(F.col("description"), F.col("category")).alias("k")).collect()}
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/assetweave/{spark.sparkContext.applicationId}"
    written = lambda: {x for x in os.listdir(folder)} if os.path.isdir(folder) else set()
    hits = {(i, d): sum(k in (body or "").lower() for k in kws[i]) for i, *_ in items for d, body, *_ in docs}
    before = written()
    got = linking.coverage_links(left, right, 0.5).select("item_id", "doc_id", "hits")
    assert rows(got) == sorted((*k, n) for k, n in hits.items() if kws[k[0]] and n >= 0.5 * len(kws[k[0]]) - 1e-9) and got.count() > 20
    assert {x.split("-")[0] for x in written() - before} == {"items"}
    before = written()
    free = linking.link_bounds(left, right, 20, linking.NAMED).select("item_id", "doc_id", "hits")  # lengths alone can reach that
    assert {(r.item_id, r.doc_id): r.hits for r in free.collect()}.items() <= hits.items() and free.count() > 5
    assert {x.split("-")[0] for x in written() - before} <= {"items", "texts", "groups", "grams"}
    assert sum(x.startswith("texts") for x in written() - before) == 1


def test_numbering_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(row):
        seen.add(1)
        return row
    df = spark.createDataFrame(spark.range(200, numPartitions=4).rdd.map(look), "id long")
    assert [r.number for r in ranking.number_rows(df, F.desc("id")).orderBy("id").collect()] == list(range(200, 0, -1))
    assert seen.value == 200


@pytest.fixture
def long_library(spark, tmp_path):
    """Tables with texts round the length of a preview and far beyond it, repeated ids, and items with and without a match."""
    texts = ["red pump " + "x" * n for n in (0, 190, 191, 192, 5000)] + ["red pump", "red pump \U0001f600" * 60, None, "blue " * 3000]
    docs = [(None if i == 5 else i // 2, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "red pump"), (1, "red"), (2, "green hose"), (3, None), (4, "blue")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_match_report_moves_previews_only(spark, long_library):
    import glob

    from assetweave.plans.catalog import links, storage
    from assetweave.session import shared_folder

    found = links.matches(spark, long_library, "text")
    n = links.plain_items(spark, long_library).select("item_id").join(found.select("item_id"), "item_id", "left").count()
    before = set(glob.glob(os.path.dirname(shared_folder(spark, "x")) + "/*"))
    got = storage.match_report(spark, long_library).collect()
    assert [(r.items, r.detail_rows, r.vendors) for r in got] == [(5, n, 3)]
    new = {os.path.basename(f).split("-")[0]: f for f in set(glob.glob(os.path.dirname(shared_folder(spark, "x")) + "/*")) - before}
    assert spark.read.parquet(new["matches"]).agg(F.max(F.length("text_preview"))).first()[0] == 203
    assert "text" not in spark.read.parquet(new["matches"]).columns
    detail = reports.match_detail(links.plain_items(spark, long_library), found)
    written = spark.read.parquet(new["report"] + "/detail").select(detail.columns)
    assert sorted(map(repr, written.collect())) == sorted(map(repr, detail.collect()))


def test_match_detail_joins_previews_only(spark, long_library):
    from assetweave.plans.catalog import links

    got = links.match_detail(spark, long_library)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("length(text"):]
    whole = reports.match_detail(links.plain_items(spark, long_library), links.matches(spark, long_library, "text")).drop("description")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert {len(r.text_preview) for r in got.collect()} == {0, 8, 9, 199, 200, 203}


@pytest.mark.parametrize("block", [1 << 14, 2])
def test_text_signals_split_a_text_once_for_all_its_pairs(spark, tmp_path, monkeypatch, block):
    from assetweave.plans.catalog import documents
    from assetweave.plans.catalog.registry import items as catalog_items, library

    monkeypatch.setattr(linking, "BLOCK", block)
    texts = ["Lab tools: red pump PX-200, steel hose, ölpumpe straße STRASSE", "lab tools red pump", None, "RED PUMP steel hose for labs ab1 Ab1 ABC", "a\tred\npump", ""]
    spark.createDataFrame([(i // 2 if i != 3 else None, t, "en", "s", 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    found = [None, "red pump, steel hose", "Red pump PX-200, straße", "lab", "steel, hose", "red, ABC ab1", "red pump", "ölpumpe"]
    spark.createDataFrame([(i if i < 6 else 4, t) for i, t in enumerate(found)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = documents.text_signals(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(held") < plan.index("upper(doc")
    docs = library(spark, str(tmp_path)).select("doc_id", F.lower("text").alias("doc"))
    pairs = linking.coverage_links(catalog_items(spark, str(tmp_path)), library(spark, str(tmp_path)), 0.5, "full").select("item_id", "doc_id")
    wanted = catalog_items(spark, str(tmp_path)).select("item_id", F.lower("description").alias("low"), text.search_keywords(F.col("description"), F.col("category"), "full").alias("kw"))
    low, doc = F.col("low"), F.col("doc")
    want = pairs.join(wanted, "item_id").join(docs, "doc_id").select(
        "item_id", "doc_id", F.round(text.coverage(F.col("kw"), doc), 6), F.round(text.structural_overlap(low, doc), 6), F.round(text.word_overlap(low, doc), 6),
        F.exists(F.split(low, ","), lambda p: (F.length(text.strip(p)) > 5) & F.contains(doc, text.strip(p))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert {r.phrase for r in got.collect()} == {True, False, None} and got.count() > 20
