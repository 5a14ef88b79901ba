"""Linking items to documents by a text score.

The score of a pair is driven by how many of the item's keywords occur in the document.
Reading the texts of every pair is quadratic, so hits are counted first, exactly:

1. Documents fall into classes by length (bands of a factor of 1.4) and by the points that their name
   gives or takes. An item can only reach the threshold in a class if at least `need` of its `n`
   keywords hit, where `need` follows from the largest ratio that lengths of the band allow,
   the points of the class, and the words of the item that occur in any file name at all.
2. A text moves once, to a task that also gets the keywords of a block of items. A keyword can only hit where one word of the
   document contains the keyword's longest word, so the substrings of each distinct word are looked up among the block's keywords, and hits
   are counted per item with a list of items per keyword. Keywords of several pieces are then looked for in the text. Where `need` is 0, all
   documents of the class are candidates; a low threshold allows that in the bands next to the item's own length.

Scores see whole texts, all keywords and all documents. Leading characters, a least text
length and a number of keywords are fields of `Score` that a caller may set. Pairs that
survive are pruned with a native upper bound and with the longest common
subsequence, and only then sent to the similarity function. Intermediate tables are written while a link is built.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import names, text
from assetweave.functions.arrays import explode_computed
from assetweave.functions.similarity import ratio_bound, sequence_ratio, subsequence_bound
from assetweave.operators.filters import include_types
from assetweave.operators.ranking import dedup_matches
from assetweave.operators.resolve import apply_aliases, resolve_entities
from assetweave.operators.substring import substring_pairs
from assetweave.session import cut_lineage, task_count


# --- scores -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Score:
    """A match score between 0 and 100, monotone in the similarity ratio.

    `sample` lets the ratio see that many leading characters only, `min_text` gives shorter
    texts a score of 0, `keyword_cap` keeps that many of the longest keywords.
    """

    kind: str
    keyword_weight: float
    ratio_weight: float
    sample: int | None = None
    min_text: int = 0
    keywords: str = "short"
    keyword_cap: int | None = None
    name_boost: bool = False

    def limited(self, **limits) -> "Score":
        """The same score with limits, such as `NAMED.limited(sample=2000, min_text=800)`."""
        return replace(self, **limits)

    def ratio_text(self, low_text: Column) -> Column:
        return low_text if self.sample is None else F.substring(low_text, 1, self.sample)

    def needed_share(self, low_description: Column, threshold: float, longest_ratio: Column, gain: Column,
                     name_share: Column) -> Column:
        """Smallest keyword coverage with which a document of a class can still reach the threshold.

        `longest_ratio` bounds the ratio in the class, `gain` is what the class adds, `name_share` bounds the share of
        words that a name holds.
        """
        if self.kind == "four_signal":
            # 1.3 * (weight * share + ratio + structure + words) >= threshold
            return (threshold / 1.3 - 30.0 - self.ratio_weight * longest_ratio) / self.keyword_weight
        named = 15.0 * name_share if self.kind == "named" else F.lit(0.0)
        return (threshold - gain - named - self.ratio_weight * longest_ratio) / self.keyword_weight

    def gain(self, file_name: Column, threshold: float) -> Column:
        """Points that a file name adds to the score, or takes from it; 100 where they reach the threshold alone."""
        plus, minus = F.lit(0.0), F.lit(0.0)
        if self.kind == "named":
            name = F.lower(file_name)
            plus = F.when(text.contains_any(name, rules.TECHNICAL_NAME_PARTS), 10.0).otherwise(0.0)
            minus = F.when(text.contains_any(name, rules.MARKETING_NAME_PARTS), 15.0).otherwise(0.0)
        if self.name_boost:
            plus = plus + self._name_points(file_name)
        return F.coalesce(F.when(plus >= threshold, 100.0).otherwise(plus - minus), F.lit(100.0))

    @staticmethod
    def _name_points(file_name: Column) -> Column:
        category, points = names.doc_category(file_name), F.lit(0)
        for label, more in rules.PRIORITY_BOOST.items():
            points = F.when(category == label, more).otherwise(points)
        return points

    def floor(self) -> float:
        """Above this threshold every match has at least one keyword hit, whatever the pair."""
        if self.kind == "four_signal":
            return 1.3 * (100 - self.keyword_weight)
        return (self.ratio_weight + (25 if self.kind == "named" else 0) + (15 if self.name_boost else 0))

    def total(self, low_description: Column, low_text: Column, share: Column, file_name: Column,
              ratio: Column) -> Column:
        score = self._combined(low_description, low_text, share, file_name, ratio)
        return F.when(F.length(text.strip(low_text)) < self.min_text, 0.0).otherwise(score) \
            if self.min_text else score

    def _combined(self, low_description: Column, low_text: Column, share: Column, file_name: Column,
                  ratio: Column) -> Column:
        name = F.lower(file_name)
        if self.kind == "named":
            said = text.words(low_description)
            in_name = F.size(F.filter(said, lambda w: (F.length(w) > 3) & F.contains(name, w)))
            score = (share * self.keyword_weight + ratio * self.ratio_weight
                     + text.ratio_or_zero(in_name, F.size(said)) * 15.0)
            penalty = F.when(text.contains_any(name, rules.MARKETING_NAME_PARTS), 15.0).otherwise(0.0)
            boost = F.when(text.contains_any(name, rules.TECHNICAL_NAME_PARTS), 10.0).otherwise(0.0)
            score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score - penalty) + boost)
        elif self.kind == "four_signal":
            score = (share * self.keyword_weight + ratio * self.ratio_weight
                     + 0.2 * text.structural_overlap(low_description, low_text)
                     + 0.1 * text.word_overlap(low_description, low_text))
            factor = F.when(text.exact_phrase(low_description, low_text), 1.3).otherwise(1.0)
            score = F.least(score * factor, F.lit(100.0))
        else:
            score = F.least(share * self.keyword_weight + ratio * self.ratio_weight, F.lit(100.0))
        if self.name_boost:
            score = F.least(score + self._name_points(file_name), F.lit(100.0))
        return score


NAMED = Score("named", 60, 25)
PLAIN = Score("plain", 70, 30)
BOOSTED = Score("plain", 70, 30, name_boost=True)
FOUR_SIGNAL = Score("four_signal", 40, 30, keywords="full")
EVEN = Score("plain", 50, 50, keywords="strict")


# --- candidates -------------------------------------------------------------------------

BLOCK = 1 << 14  # items whose keywords one task holds at a time
BUCKET = 500  # documents of a group that are worth a task, and its share of the keywords


def _rows(df: DataFrame, name: str, label: str) -> DataFrame:
    """The written table with a number per row, as ids may repeat."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()), label)


def _make_matcher(kept: list[str]):
    # nested, so that it ships by value and workers need not import this package
    def finder(rows):
        """A function that counts the hits of a block of items in a text: (items, hits) of those that reach the need of its class."""
        import re

        import numpy as np

        plain, compound, needs = {}, {}, {}
        for i, (_, keywords, pieces, asked) in enumerate(rows):
            for keyword, piece in zip(keywords, pieces, strict=True):
                if piece == keyword:
                    plain.setdefault(piece, []).append(i)
                elif piece is not None:
                    compound.setdefault(piece, {}).setdefault(keyword, []).append(i)
            for x in asked:
                needs.setdefault(x["class"], np.full(len(rows), np.iinfo(np.int32).max, np.int32))[i] = x["need"]
        ids, none = np.array([r[0] for r in rows], np.int64), np.zeros(0, np.int32)
        number = {k: i for i, k in enumerate({**plain, **compound})}
        asking = [np.array(plain.get(k, ()), np.int32) for k in number]
        compound = {number[k]: [(w, np.array(x, np.int32)) for w, x in of.items()] for k, of in compound.items()}
        short, starts = sorted({len(k) for k in number if len(k) < 3}), {}
        for k in number:
            if len(k) >= 3:
                starts.setdefault(k[:3], set()).add(len(k))
        no_word = r"\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F"  # ASCII that no word holds; other pieces may, but no blanks
        odd = any(re.search(f"[{no_word}]", k) for k in number)
        split, known = re.compile(r"[^ \t\n\r]+" if odd else f"[^{no_word}]+").findall, {}

        def look_up(word):
            held = set()
            for j in range(len(word)):
                for n in starts.get(word[j:j + 3], ()):
                    held.add(number.get(word[j:j + n]))
                for n in short:
                    held.add(number.get(word[j:j + n]))
            held.discard(None)
            held = tuple(held)
            if len(word) <= 64:
                known[word] = held
            return held

        def find(text, kind):
            need = needs.get(kind)
            if need is None:
                return None
            if len(known) >= 500_000:
                known.clear()
            held = {k for word in set(split(text)) for k in (known[word] if word in known else look_up(word))}
            hit = [asking[k] for k in held]
            hit += [items for k in compound.keys() & held for keyword, items in compound[k] if keyword in text]
            counts = np.bincount(np.concatenate(hit) if hit else none, minlength=len(rows))
            at = np.flatnonzero(counts >= need)
            return (ids[at], counts[at]) if len(at) else None

        return find

    def match(batches):
        import numpy as np
        import pyarrow as pa

        def out(batch, places, found):
            sizes = np.cumsum([0, *(len(ids) for ids, _ in found)])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                                                pa.array(np.concatenate([f[1] for f in found]), pa.int32())], ["_item", "hits"])
            rows = batch.select(kept).take(pa.array(places))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], [*kept, "_found"])

        group, rows, find = None, [], None
        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            places, found, n = [], [], 0
            for i, key in enumerate(zip(at["_group"].to_pylist(), at["_block"].to_pylist(), strict=True)):
                if key != group:  # a group's items come before its documents
                    group, rows, find = key, [], None
                if at["_kind"][i].as_py() == 0:
                    rows.append(tuple(at[c][i].as_py() for c in ("_item", "_keywords", "_pieces", "_needs")))
                    continue
                find = find or finder(rows)
                got = find(at["_text"][i].as_py() or "", at["_class"][i].as_py())
                if got is not None:
                    places.append(i)
                    found.append(got)
                    n += len(got[0])
                    if n > 1 << 16:
                        yield out(batch, places, found)
                        places, found, n = [], [], 0
            if places:
                yield out(batch, places, found)

    return match


def matched_docs(items: DataFrame, docs: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The `keep` columns of the documents with `_found`, an array of (_item, hits): the items with as many keyword hits as the
    document's class asks for.

    `items` carries _item, `_keywords`, the `by` columns and `_needs`, an array of (class, need); classes that it lacks are out
    of reach. `docs` carries `_text` in lower case, `_class`, the `by` and the `keep` columns. Documents are dealt to tasks, each text moves
    once for every BLOCK items; with them go the items of their `by` group.
    """
    n, group = task_count(docs.sparkSession), F.to_json(F.struct(*by)) if by else F.lit("")
    left = items.select(group.alias("_group"), F.col("_item").cast("long").alias("_item"), "_keywords",
                        F.transform("_keywords", text.lookup_piece).alias("_pieces"), "_needs", *by)
    right = docs.select(group.alias("_group"), *dict.fromkeys([*keep, "_text", "_class", *by]))
    if by:
        sizes = left.dropna(subset=by).groupBy("_group").agg(F.count("*").alias("n")) \
            .join(right.dropna(subset=by).groupBy("_group").agg(F.count("*").alias("m")), "_group")
        sizes = cut_lineage(sizes.select("_group", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks"),
                                         F.least(F.ceil(F.col("m") / BUCKET), F.lit(n)).cast("int").alias("_buckets")), "groups")
        left, right = left.join(sizes, "_group"), right.join(sizes, "_group")
    else:
        blocks = max(1, -(-items.count() // BLOCK))
        left, right = [x.withColumns({"_blocks": F.lit(blocks), "_buckets": F.lit(n)}) for x in (left, right)]
    first = F.col("_group"), F.col("_block")
    left = left.withColumn("_block", F.pmod(F.xxhash64("_item"), "_blocks").cast("int")) \
        .withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).withColumn("_kind", F.lit(0))
    right = right.withColumn("_bucket", F.pmod(F.xxhash64(*keep, "_text"), "_buckets").cast("int")) \
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_kind", F.lit(1))
    both = right.drop("_blocks", "_buckets", *[c for c in by if c not in keep]) \
        .unionByName(left.drop("_blocks", "_buckets", *by), allowMissingColumns=True)
    # the buckets of a group go to different tasks
    dealt = both.repartitionById(n, F.pmod(F.xxhash64(*first) + F.col("_bucket"), F.lit(n)).cast("int")) \
        .drop("_bucket").sortWithinPartitions(*first, "_kind")
    schema = docs.select(*keep, F.expr("CAST(array() AS array<struct<_item: bigint, hits: int>>)").alias("_found")).schema
    return dealt.mapInArrow(_make_matcher(keep), schema)


def candidate_pairs(items: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """(_item, _doc, hits): pairs that have as many keyword hits as the document's class asks for, of tables as `matched_docs` takes them."""
    return matched_docs(items, docs, by, ["_doc"]).select("_doc", F.inline("_found")).select("_item", "_doc", "hits")


BANDS = 2.0  # bands of lengths per factor of two


def _band(n: Column) -> Column:
    return F.floor(F.log2(n) * BANDS).cast("int")


def _longest_ratio(n: Column, band: int) -> Column:
    """The largest ratio that a text whose length lies in the band can reach with one of length n."""
    low, high = 2.0 ** (band / BANDS) * (1 - 1e-9), 2.0 ** ((band + 1) / BANDS) * (1 + 1e-9)
    return F.when(n < low, 2.0 * n / (n + low)).when(n > high, F.lit(2.0 * high) / (n + high)).otherwise(1.0)


def _name_shares(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, _name_share): the share of an item's words that occur in some file name."""
    said = explode_computed(items, text.words(F.col("_low")), "needle", "item_id", F.size(text.words(F.col("_low"))).alias("n"))
    long_ = said.filter(F.length("needle") > 3)
    parts = explode_computed(docs, text.words(F.lower("file_name")), "hay").distinct()
    known = substring_pairs(long_.select("needle").distinct(), parts).select("needle").distinct()
    return long_.join(known, "needle").groupBy("item_id").agg((F.count("*") / F.max("n")).alias("_name_share"))


# --- links --------------------------------------------------------------------------------

def _prepared_items(items: DataFrame, score: Score) -> DataFrame:
    return items.filter(F.length(F.col("description")) > 0) \
        .withColumn("_low", F.lower("description")) \
        .withColumn("_keywords", text.search_keywords(
            F.col("description"), F.col("category") if "category" in items.columns else None,
            score.keywords, score.keyword_cap)) \
        .filter(F.size("_keywords") > 0)


def _with_needs(items: DataFrame, classes: list[tuple[int, float]], score: Score, threshold: float) -> DataFrame:
    """Items with `_needs`, the hits that they need in each class of documents where the threshold is in reach."""
    n, size = F.length("_low").cast("double"), F.size("_keywords")

    def needed(i: int, band: int, gain: float) -> Column:
        share = score.needed_share(F.col("_low"), threshold, _longest_ratio(n, band), F.lit(gain), F.col("_name_share"))
        return F.struct(F.lit(i).alias("class"), F.greatest(F.ceil(share * size - 1e-9).cast("int"), F.lit(0)).alias("need"))
    every = F.array(*[needed(i, band, gain) for i, (band, gain) in enumerate(classes)])
    return items.withColumn("_needs", F.filter(every, lambda x: x["need"] <= size)).filter(F.size("_needs") > 0)


def _bounded(items: DataFrame, docs: DataFrame, threshold: float, score: Score, by: str | None) -> DataFrame:
    """Pairs whose keyword hits, name part and largest possible ratio reach the threshold, with what scores them."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    if not by and threshold <= score.floor():
        raise ValueError(f"threshold must exceed {score.floor()} when no join column is given: below "
                         "it pairs without any common keyword could match")
    keys = ["_by"] if by else []
    left = _prepared_items(items, score)
    right = docs.withColumn("_text", F.lower("text")).filter(F.length("_text") > 0)
    if by:
        left = left.withColumn("_by", F.lower(text.strip(F.col(by)))).filter("_by is not null")
        right = right.withColumn("_by", F.lower(text.strip(F.col(by))))
        right = right.join(left.select("_by").distinct(), "_by", "left_semi")
    if score.min_text:  # such texts score 0
        right = right.filter(F.length(text.strip(F.col("_text"))) >= score.min_text)
    left = left.filter("item_id IS NOT NULL").select("item_id", "_low", "_keywords", *keys)
    right = right.filter("doc_id IS NOT NULL").select("doc_id", "file_name", "_text", _band(F.length(score.ratio_text(F.col("_text")))).alias("_length"),
                         score.gain(F.col("file_name"), threshold).alias("_gain"), *keys)
    right = cut_lineage(right, "texts")
    # bands of lengths and sums of a few points: some hundreds, whatever the number of documents
    classes = sorted((r[0], r[1]) for r in right.select("_length", "_gain").distinct().collect())
    if not classes:
        classes = [(0, 0.0)]
    number = F.create_map(*[F.lit(x) for i, (band, gain) in enumerate(classes) for x in (f"{band} {gain}", i)])
    right = right.withColumn("_class", number[F.concat_ws(" ", F.col("_length").cast("string"), F.col("_gain").cast("string"))]).drop("_length", "_gain")
    if score.kind == "named":
        left = left.join(_name_shares(left, docs), "item_id", "left").withColumn("_name_share", F.coalesce("_name_share", F.lit(0.0)))
    else:
        left = left.withColumn("_name_share", F.lit(0.0))
    left = _rows(_with_needs(left, classes, score, threshold).drop("_name_share"), "_item", "items")
    joined = matched_docs(left, right, keys, ["doc_id", "file_name", "_text"]).select("doc_id", "file_name", "_text", F.inline("_found")) \
        .join(left.drop("_needs", *keys), "_item").withColumn("coverage", F.col("hits") / F.size("_keywords"))
    bound = score.total(*_parts(), ratio_bound(F.col("_low"), score.ratio_text(F.col("_text"))))
    return joined.withColumn("bound", bound).filter(F.col("bound") >= threshold - 1e-9)


def _parts() -> list[Column]:
    return [F.col(c) for c in ("_low", "_text", "coverage", "file_name")]


def link_bounds(items: DataFrame, docs: DataFrame, threshold: float = rules.LINK_THRESHOLD,
                score: Score = NAMED, by: str | None = "supplier") -> DataFrame:
    """(item_id, doc_id, hits, coverage, bound): the pairs that `link` compares letter by letter, and the most each can score."""
    return _bounded(items, docs, threshold, score, by).select("item_id", "doc_id", "hits", "coverage", "bound")


def link(items: DataFrame, docs: DataFrame, threshold: float = rules.LINK_THRESHOLD,
         score: Score = NAMED, by: str | None = "supplier") -> DataFrame:
    """Items joined to the documents that reach `threshold`.

    items(item_id, description[, category][, supplier]) with one row per item_id;
    docs(doc_id, file_name, text[, supplier]) with one row per doc_id. With `by` both
    sides must agree on that column (lower case, trimmed); with `by=None` every item may
    meet every document. Returns item_id, doc_id, hits, coverage, ratio and score.
    """
    sample = score.ratio_text(F.col("_text"))
    bounded = _bounded(items, docs, threshold, score, by).withColumn("_most", subsequence_bound(F.col("_low"), sample))
    return (bounded.filter(score.total(*_parts(), F.col("_most")) >= threshold - 1e-9)
            .withColumn("ratio", sequence_ratio(F.col("_low"), sample))
            .withColumn("score", score.total(*_parts(), F.col("ratio")))
            .filter(F.col("score") >= threshold)
            .select("item_id", "doc_id", "hits", "coverage", "ratio", "score"))


def coverage_links(items: DataFrame, docs: DataFrame, min_coverage: float,
                   variant: str = "short", cap: int | None = None) -> DataFrame:
    """(item_id, doc_id, hits, n_keywords, coverage) with at least `min_coverage`, all docs."""
    if not 0 < min_coverage <= 1:
        raise ValueError("min_coverage must be in (0, 1]")
    left = items.withColumn("_keywords", text.search_keywords(
        F.col("description"), F.col("category") if "category" in items.columns else None, variant, cap)) \
        .filter(F.size("_keywords") > 0) \
        .withColumn("_need", F.greatest(F.ceil(min_coverage * F.size("_keywords") - 1e-9).cast("int"), F.lit(1)))
    left = _rows(left.filter("item_id IS NOT NULL").select("item_id", "_keywords", F.array(F.struct(F.lit(0).alias("class"), F.col(
        "_need").alias("need"))).alias("_needs")), "_item", "items")
    right = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("_text"), F.lit(0).alias("_class"))
    pairs = matched_docs(left, right, [], ["doc_id"]).select("doc_id", F.inline("_found"))
    return pairs.join(left.select("_item", "item_id", F.size("_keywords").alias("n_keywords")), "_item").select(
        "item_id", "doc_id", "hits", "n_keywords", (F.col("hits") / F.col("n_keywords")).alias("coverage"))


def best_link(links: DataFrame, score: str = "coverage") -> DataFrame:
    """The best document per item, ties to the smallest doc_id; pre-aggregated, no window."""
    return (links.groupBy("item_id")
            .agg(F.min(F.struct((-F.col(score)).alias("s"), "doc_id")).alias("b"),
                 F.count("*").alias("n_docs"))
            .select("item_id", F.col("b.doc_id").alias("doc_id"),
                    (-F.col("b.s")).alias(score), "n_docs"))


# --- items to the folder of their supplier ------------------------------------------------------

def route_items(items: DataFrame, docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Items with `folder`, the supplier name under which their documents lie, and how it was found; null when there is none.

    aliases(supplier, folder) come first; other names are matched with the suppliers of docs(supplier, ...).
    """
    named = apply_aliases(items, aliases) if aliases is not None else items.withColumn("folder", F.col("supplier"))
    named = named.withColumnRenamed("folder", "_said")
    found = resolve_entities(named.select(F.col("_said").alias("name")), docs.select(F.col("supplier").alias("target")))
    found = found.select(F.col("name").alias("_name"), F.col("target").alias("folder"), "strategy")
    return named.join(found, F.col("_said") == F.col("_name"), "left").drop("_said", "_name")


def link_items(items: DataFrame, docs: DataFrame, threshold: float = rules.LINK_THRESHOLD, score: Score = BOOSTED,
               fallback: Score = PLAIN, aliases: DataFrame | None = None) -> DataFrame:
    """The item-wise flow: items meet the documents of their folder, items without a folder meet all documents; of the
    matches of an item whose file names fold to one, the best stays.

    Returns item_id, file_key, score, file_name, doc_id and `fallback`.
    """
    routed = cut_lineage(route_items(items, docs, aliases), "routed")
    placed = routed.filter("folder is not null").drop("supplier").withColumnRenamed("folder", "supplier")
    near = link(placed, docs, threshold, score).withColumn("fallback", F.lit(False))
    far = link(routed.filter("folder is null"), docs, threshold, fallback, by=None).withColumn("fallback", F.lit(True))
    both = near.unionByName(far).join(docs.select("doc_id", "file_name"), "doc_id")
    return dedup_matches(both.select("item_id", "doc_id", "score", "file_name", "fallback"))


def link_master_folders(items: DataFrame, docs: DataFrame, master: DataFrame, threshold: float = rules.LINK_THRESHOLD,
                        score: Score = PLAIN, aliases: DataFrame | None = None, type_column: str | None = None) -> DataFrame:
    """All items, or those labelled as instruments, against the documents of the folders that master(supplier) lists.

    An alias (supplier, folder) stands for the listed name.
    """
    wanted = include_types(items, type_column) if type_column else items
    listed = master.select("supplier")
    if aliases is not None:
        listed = apply_aliases(listed, aliases).select(F.col("folder").alias("supplier"))
    fold = lambda c: F.lower(text.strip(F.col(c)))
    kept = docs.join(listed.select(fold("supplier").alias("_listed")).distinct(), fold("supplier") == F.col("_listed"), "left_semi")
    return link(wanted, kept, threshold, score, by=None)
