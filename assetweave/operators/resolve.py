"""Supplier resolution: known names, entity matching, URL confidence, routing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import names, text, urls
from assetweave.functions.arrays import explode_computed
from assetweave.functions.similarity import sequence_ratio
from assetweave.operators import similar
from assetweave.session import cut_lineage, task_count


def _key(c: str) -> Column:
    return F.upper(text.strip(F.col(c)))


# --- known suppliers --------------------------------------------------------------------

def load_master(df: DataFrame, name: str, website: str, position: str) -> DataFrame:
    """master(supplier, website): one row per upper-case name, the last duplicate wins.

    Rows without a name or website are unknown. `position` orders the source rows.
    """
    return (df.filter(F.col(name).isNotNull() & (F.col(name) != "")
                      & F.col(website).isNotNull() & (F.col(website) != ""))
            .groupBy(_key(name).alias("supplier"))
            .agg(F.max_by(text.strip(F.col(website)), F.col(position)).alias("website")))


def load_supplier_pairs(df: DataFrame, name: str, website: str) -> DataFrame:
    """(supplier, website) rows with a name and a valid URL; duplicates stay."""
    if name not in df.columns or website not in df.columns:
        return df.sparkSession.createDataFrame([], "supplier string, website string")
    return (df.select(text.strip(F.col(name)).alias("supplier"), text.strip(F.col(website)).alias("website"))
            .filter((F.col("supplier") != "") & urls.valid_url(F.col("website"))))


def distinct_suppliers(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(_key(column).alias("supplier")).distinct()


def split_known(suppliers: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suppliers with a website in the master list, and those still to resolve."""
    known = suppliers.join(master, "supplier").select(
        "supplier", "website", F.lit("master_list").alias("source"))
    return known, suppliers.join(master, "supplier", "left_anti")


def attach_master(items: DataFrame, master: DataFrame, fold: bool = False) -> DataFrame:
    """Left join of the website on `supplier`; `fold` ignores case and outer blanks."""
    if not fold:
        return items.join(master, "supplier", "left")
    def key(c):
        return F.lower(text.strip(F.col(c)))
    folded = master.groupBy(key("supplier").alias("_key")).agg(F.max("website").alias("website"))
    return items.withColumn("_key", key("supplier")).join(folded, "_key", "left").drop("_key")


def missing_suppliers(items: DataFrame, master: DataFrame, order: str) -> DataFrame:
    """One row per supplier without a usable website: its first item and the reason."""
    first = items.groupBy("supplier").agg(F.min_by(F.struct("item_code", "description"), F.col(order)).alias("i"))
    blank = F.coalesce(text.strip(F.col("website")) == "", F.lit(True))
    return (first.join(master.withColumn("_listed", F.lit(True)), "supplier", "left").filter(blank)
            .select("supplier", F.col("i.item_code").alias("item_code"),
                    F.col("i.description").alias("description"),
                    F.when(F.col("_listed"), "In Master List but No Website")
                    .otherwise("Missing from Master List").alias("status")))


def join_audit(items: DataFrame, master: DataFrame) -> DataFrame:
    """Row counts by outcome of the left join with the master list.

    Items are counted per supplier first, so a hot supplier meets the join as one row.
    """
    counted = items.groupBy("supplier").agg(F.count("*").alias("n"))
    marked = counted.join(master.select("supplier", F.lit("both").alias("m")), "supplier", "left")
    return marked.groupBy(F.coalesce("m", F.lit("left_only")).alias("outcome")).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("suppliers"))


def append_if_absent(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: unseen keys, one row per key, the first by `order`."""
    fresh = rows.join(existing.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c != key]
    return (fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in rest]))


def union_sources(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """The list handed to harvesting: known suppliers and the automatically resolved ones."""
    auto = resolved.filter(F.col("status") == "Auto-Added").select(
        "supplier", F.col("url").alias("website"), F.lit("auto_resolved").alias("source"))
    return known.select("supplier", "website", "source").unionByName(auto)


def apply_aliases(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folder name per item: aliases(supplier, folder) first, the supplier itself otherwise."""
    return items.join(aliases, "supplier", "left").withColumn("folder", F.coalesce("folder", "supplier"))


# --- entity matching ----------------------------------------------------------------------

def resolve_entities(suppliers: DataFrame, targets: DataFrame,
                     strategies=("exact", "containment", "words", "cleaned")) -> DataFrame:
    """(name, target, strategy): the first strategy that hits, then the first target.

    suppliers(name), targets(target); blank values never match. Targets are ordered by
    text. Every stage is an equi-join on distinct names and only keeps each name's
    smallest target, so popular words and fragments are aggregated before they meet.
    Distinct names and the hits of each stage are materialised, as later stages reuse them.
    """
    todo = cut_lineage(suppliers.filter(text.strip(F.col("name")) != "").select("name").distinct()
                       .withColumn("low", F.lower("name")))
    goal = cut_lineage(targets.filter(text.strip(F.col("target")) != "").select("target").distinct()
                       .withColumn("tlow", F.lower("target")))
    stages = {"exact": _exact, "containment": _containment, "words": _word_overlap, "cleaned": _cleaned}
    found = None
    for i, strategy in enumerate(strategies):
        hits = stages[strategy](todo, goal).withColumn("strategy", F.lit(strategy))
        if i + 1 < len(strategies):  # the next stage starts from what is left, not from this plan
            hits = cut_lineage(hits)
            todo = todo.join(hits.select("name"), "name", "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return found


def _exact(todo: DataFrame, goal: DataFrame) -> DataFrame:
    first = goal.groupBy(F.col("tlow").alias("low")).agg(F.min("target").alias("target"))
    return todo.join(first, "low").select("name", "target")


def _substrings(df: DataFrame, c: str, lengths: list[int], *keep: str) -> DataFrame:
    """A row per distinct substring `sub` of one of these lengths: at most characters times lengths."""
    n = F.length(c)
    of = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= n)
    parts = F.flatten(F.transform(of, lambda x: F.transform(F.sequence(F.lit(1), n - x + 1), lambda i: F.substring(F.col(c), i, x))))
    return explode_computed(df.repartition(task_count(df.sparkSession), c), F.array_distinct(parts), "sub", *keep)


def _lengths(df: DataFrame, c: str) -> list[int]:
    """The lengths that occur: as many as the longest name has characters, at most."""
    return sorted(r[0] for r in df.select(F.length(c)).distinct().collect())


def _containment(todo: DataFrame, goal: DataFrame) -> DataFrame:
    """The smallest target inside a name or around it.

    A dictionary of the targets' substrings, of the lengths that names have, keeps the smallest target of each; names look
    themselves up in it. Names look up their own substrings, of the lengths that targets have, among the targets. So no pair of
    a name and a target exists before the minimum is taken, however many contain each other.
    """
    mine = todo.select("low").distinct()
    # smallest target per spelling
    spelled = cut_lineage(goal.groupBy("tlow").agg(F.min("target").alias("target")), "spelled")
    sizes, theirs = _lengths(mine, "low"), _lengths(spelled, "tlow")
    if not sizes or not theirs:
        return todo.select("name", F.lit("").alias("target")).limit(0)
    around = _substrings(spelled, "tlow", sizes, "target").groupBy("sub").agg(F.min("target").alias("target"))
    inside = _substrings(mine, "low", theirs, "low").join(spelled, F.col("sub") == F.col("tlow"))
    both = mine.join(around, F.col("low") == F.col("sub")).select("low", "target").unionByName(inside.select("low", "target"))
    return todo.join(both.groupBy("low").agg(F.min("target").alias("target")), "low").select("name", "target")


def _word_overlap(todo: DataFrame, goal: DataFrame) -> DataFrame:
    mine = todo.select("low", F.array_sort(F.array_distinct(text.split_words(F.col("low")))).alias("ws")) \
        .distinct().withColumn("need", F.greatest(F.lit(1), F.ceil(F.size("ws") * 0.5).cast("int")))
    theirs = goal.select("target", F.array_distinct(text.split_words(F.col("tlow"))).alias("tws"))
    by_word = explode_computed(theirs, F.col("tws"), "w", "target", "tws")
    # one common word is enough: the smallest target of each word decides
    first = by_word.groupBy("w").agg(F.min("target").alias("target"), F.count("*").alias("n"))
    single = explode_computed(mine.filter("need = 1"), F.col("ws"), "w", "low").join(first, "w") \
        .groupBy("low").agg(F.min("target").alias("target"))
    # more are needed: meet on the rarest words only, then check the whole word sets
    several = mine.filter("need > 1")
    ranked = (explode_computed(several, F.col("ws"), "w", "low", "need", F.size("ws").alias("k"))
              .join(first.select("w", "n"), "w", "left")
              .groupBy("low", "need", "k").agg(F.array_sort(F.collect_list(
                  F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("r"))
              .select("low", F.explode(F.slice("r", 1, F.col("k") - F.col("need") + 1)).alias("p"))
              .select("low", F.col("p.w").alias("w")))
    pairs = ranked.join(by_word.select("w", "target"), "w").select("low", "target").distinct()
    checked = (pairs.join(theirs, "target").join(several.select("low", "ws", "need"), "low")
               .filter(F.size(F.array_intersect("ws", "tws")) >= F.col("need"))
               .groupBy("low").agg(F.min("target").alias("target")))
    return todo.join(single.unionByName(checked), "low").select("name", "target")


def _cleaned(todo: DataFrame, goal: DataFrame) -> DataFrame:
    first = goal.groupBy(names.strip_suffixes(F.col("target"), "anchored").alias("bare")) \
        .agg(F.min("target").alias("target"))
    return todo.withColumn("bare", names.strip_suffixes(F.col("name"), "anchored")) \
        .join(first, "bare").select("name", "target")


def suggest_similar(suppliers: DataFrame, targets: DataFrame, cutoff: float = 0.6, k: int = 1) -> DataFrame:
    """(name, rank, target, ratio): the k most similar targets with ratio >= cutoff.

    Names in lower case are compared, each spelling once. Pairs come from an exact filter (see `similar`).
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be in (0, 1]")

    def folded(df: DataFrame, c: str, low: str) -> DataFrame:
        return cut_lineage(df.filter(F.length(c) > 0).select(c, F.lower(c).alias(low)).distinct())

    mine, theirs = folded(suppliers, "name", "a"), folded(targets, "target", "b")
    pairs = similar.likely_pairs(mine.select(F.col("a").alias("low")).distinct(), theirs.select(F.col("b").alias("low")).distinct(), cutoff)
    close = pairs.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= cutoff)
    scored = close.join(mine, "a").join(theirs, "b")
    window = Window.partitionBy("name").orderBy(F.desc("ratio"), "target")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k) \
        .select("name", "rank", "target", "ratio")


# --- URL confidence -------------------------------------------------------------------------

def url_score(domain: Column, url: Column, supplier: Column, agree: Column) -> Column:
    """Confidence of a candidate URL; `agree` says that both engines rank one domain first."""
    points = (F.when(agree, 40).otherwise(10)
              + F.when(urls.domain_matches(domain, supplier), 25).otherwise(0)
              + F.when(url.startswith("https://"), 15).otherwise(0)
              + F.when(urls.trusted_tld(domain), 10).otherwise(0)
              + F.when(~urls.is_directory(domain), 20).otherwise(0))
    return F.when((url == "") | (domain == ""), 0).otherwise(points)


def score_hits(hits: DataFrame, engines: tuple[str, str], per_engine: int = 3) -> DataFrame:
    """Every candidate domain of a supplier with its score.

    hits(supplier, engine, pos, url), pos counting from 1 within (supplier, engine). The
    first `per_engine` results of each engine count, and each domain once, at its first
    place. Of several rows with one place the first URL counts, so at most 2 * per_engine rows
    per supplier reach the list.
    """
    first, second = engines
    top = (hits.filter((F.col("pos") <= per_engine) & F.col("engine").isin(first, second))
           .groupBy("supplier", "engine", "pos").agg(F.min("url").alias("url"))
           .select("supplier", F.struct(
               F.when(F.col("engine") == first, 0).otherwise(1).alias("e"), "pos", "url",
               urls.url_domain(F.col("url")).alias("domain")).alias("h")))
    per = top.groupBy("supplier").agg(F.array_sort(F.collect_list("h")).alias("hs"))

    def leader(e: int) -> Column:
        lead = F.filter("hs", lambda h: (h["e"] == e) & (h["pos"] == 1))
        return F.try_element_at(lead, F.lit(1))["domain"]

    agree = F.coalesce(leader(0) == leader(1), F.lit(False))
    named = F.transform("hs", lambda h: h["domain"])
    return (per.withColumn("agree", agree).withColumn("domains", named)
            .select("supplier", "agree", "domains", F.posexplode("hs").alias("i", "h"))
            .filter((F.col("h.domain") != "")
                    & (F.array_position("domains", F.col("h.domain")) == F.col("i") + 1))
            .select("supplier", F.col("i").alias("place"), F.col("h.url").alias("url"),
                    F.col("h.domain").alias("domain"),
                    url_score(F.col("h.domain"), F.col("h.url"), F.col("supplier"), F.col("agree")).alias("score")))


def pick_best_url(suppliers: DataFrame, hits: DataFrame, engines: tuple[str, str], per_engine: int = 3) -> DataFrame:
    """(supplier, url, score): best candidate, ties to the earliest; ('', 0) without any."""
    best = score_hits(hits, engines, per_engine).groupBy("supplier").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "place", "url")).alias("b"))
    return suppliers.select("supplier").join(best, "supplier", "left").select(
        "supplier", F.coalesce("b.url", F.lit("")).alias("url"), F.coalesce(-F.col("b.s"), F.lit(0)).alias("score"))


def route_by_confidence(best: DataFrame, threshold: int = rules.AUTO_ADD_CONFIDENCE) -> DataFrame:
    auto = (F.col("score") >= threshold) & (F.col("url") != "")
    return best.withColumn("status", F.when(auto, "Auto-Added").otherwise("Pending Review"))
