"""Keyword learning: candidates from labelled items, promotion into the dictionaries.

Labelling and learning are separate: learning is an aggregate over labelled rows. Text is
reduced to (category, keyword, technical) counts before the shuffle, so common words cost
one row per task, and weights are summed from integer counts, which makes totals exact.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import text
from assetweave.functions.arrays import explode_computed


def _category(label):
    out = None
    for name, category in rules.CATEGORY_OF_LABEL.items():
        out = F.when(label == name, category) if out is None else out.when(label == name, category)
    return out


def learn_candidates(labelled: DataFrame, description: str, label: str, dictionary: DataFrame) -> DataFrame:
    """(category, keyword, sightings, weight) of tokens the label's dictionary lacks."""
    # the context is a property of the whole description: settle it below the explode;
    # a filter on the label would be pushed down and repeat the rule cascade, so rows
    # without a category get no tokens instead
    tokens = (labelled.withColumn("category", _category(F.col(label)))
              .select("category", text.technical_context(F.lower(description)).alias("technical"),
                      F.when(F.col("category").isNotNull(), text.learning_tokens(F.col(description))).alias("tokens")))
    tokens = explode_computed(tokens, F.col("tokens"), "keyword", "category", "technical")
    counts = tokens.groupBy("category", "keyword").agg(
        F.count("*").alias("sightings"), F.count_if("technical").alias("technical"))
    plain = text.keyword_weight(F.col("keyword"), F.lit(False))
    boosted = text.keyword_weight(F.col("keyword"), F.lit(True))
    return (counts.join(dictionary.select("category", "keyword").distinct(),
                        ["category", "keyword"], "left_anti")
            .select("category", "keyword", "sightings",
                    (F.col("technical") * boosted + (F.col("sightings") - F.col("technical")) * plain)
                    .alias("weight")))


def merge_candidates(*parts: DataFrame) -> DataFrame:
    """Add up candidate tables of several runs."""
    out = parts[0].select("category", "keyword", "weight")
    for part in parts[1:]:
        out = out.unionByName(part.select("category", "keyword", "weight"))
    return out.groupBy("category", "keyword").agg(F.sum("weight").alias("weight"))


def promote(candidates: DataFrame, dictionary: DataFrame,
            min_occurrences: float = rules.MIN_OCCURRENCES) -> DataFrame:
    """(category, keyword, weight, promoted, reason) of candidates heavy enough to judge."""
    verdict = text.keyword_verdict(F.col("keyword"))
    return (candidates.filter(F.col("weight") >= min_occurrences)
            .join(dictionary.select("category", "keyword").distinct(), ["category", "keyword"], "left_anti")
            .withColumn("verdict", verdict)
            .select("category", "keyword", "weight", F.col("verdict.valid").alias("promoted"),
                    F.col("verdict.reason").alias("reason")))


def updated_dictionary(dictionary: DataFrame, decisions: DataFrame) -> DataFrame:
    new = decisions.filter("promoted").select("category", "keyword")
    return dictionary.select("category", "keyword").unionByName(new)


def top_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest keywords per category; the row limit is pushed below the shuffle."""
    window = Window.partitionBy("category").orderBy(F.desc("weight"), "keyword")
    return (candidates.withColumn("rank", F.row_number().over(window))
            .filter(F.col("rank") <= k).select("category", "rank", "keyword", "weight"))


def ready_candidates(candidates: DataFrame, min_occurrences: float = rules.MIN_OCCURRENCES) -> DataFrame:
    """(category, keyword, weight) of the candidates heavy enough to be judged."""
    return candidates.filter(F.col("weight") >= min_occurrences).select("category", "keyword", "weight")


def learning_analytics(candidates: DataFrame, min_occurrences: float = rules.MIN_OCCURRENCES) -> DataFrame:
    """Per category: candidates, total and average weight, and how many are ready."""
    return candidates.groupBy("category").agg(
        F.count("*").alias("candidates"), F.sum("weight").alias("total_weight"),
        F.avg("weight").alias("avg_weight"),
        F.count_if(F.col("weight") >= min_occurrences).alias("ready"))
