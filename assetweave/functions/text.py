"""Column expressions over free text. All of them but `found_terms` stay inside the JVM."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetweave import rules

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"  # the characters a Python str.strip() removes
WORD = r"[\p{L}\p{N}_]+"
PIECE = WORD + r"|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]+"  # words and runs of other visible characters


def strip(c: Column) -> Column:
    """Trim every kind of whitespace; Spark's own trim only removes blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def split_words(c: Column) -> Column:
    """Whitespace-separated pieces, in order, without empty ones."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def pieces(c: Column) -> Column:
    """Words and runs of other visible characters, in order."""
    return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))


def lookup_piece(term: Column) -> Column:
    """The longest word of a term, or its longest other run when it has no word.

    Wherever the term occurs in a text, one piece of that text contains this one.
    """
    def longest(runs: Column) -> Column:
        keyed = F.transform(runs, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
        return F.try_element_at(F.array_sort(keyed), F.lit(1))["w"]

    return F.coalesce(longest(words(term)), longest(pieces(term)))


def contains_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms])


def literal_array(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() as array<string>)")


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# --- search keywords -----------------------------------------------------------------

def _kept_words(c: Column, stopwords: list[str], min_len: int) -> Column:
    return F.filter(words(F.lower(F.coalesce(c, F.lit("")))),
                    lambda w: (F.length(w) >= min_len) & ~w.isin(*stopwords))


def _longest(terms: Column, cap: int | None) -> Column:
    """Distinct terms in text order, or the `cap` longest (ties alphabetical) beyond it."""
    terms = F.array_sort(F.array_distinct(terms))
    if cap is None:
        return terms
    keyed = F.array_sort(F.transform(
        terms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    longest = F.transform(F.slice(keyed, 1, cap), lambda s: s["w"])
    return F.when(F.size(terms) > cap, longest).otherwise(terms)


def search_keywords(description: Column, category: Column | None = None,
                    variant: str = "short", cap: int | None = None) -> Column:
    """Distinct lower-case search terms of an item; `cap` keeps that many of the longest.

    `short`   category split on blanks, words of two or more letters
    `full`    category split on blanks, words of three or more letters
    `strict`  words of three or more letters from both fields
    """
    category = F.lit("") if category is None else F.coalesce(category, F.lit(""))
    if variant == "short":
        own = _kept_words(description, rules.SEARCH_STOPWORDS, 2)
        return _longest(F.concat(split_words(F.lower(category)), own), cap)
    if variant == "full":
        own = _kept_words(description, rules.SEARCH_STOPWORDS_LONG, 3)
        return _longest(F.concat(split_words(F.lower(category)), own), cap)
    if variant == "strict":
        both = F.concat(_kept_words(description, rules.SEARCH_STOPWORDS_LONG, 3),
                        _kept_words(category, rules.SEARCH_STOPWORDS_LONG, 3))
        return _longest(both, cap)
    raise ValueError(f"unknown keyword variant: {variant}")


def keyword_hits(keywords: Column, low_text: Column, found: Column | None = None) -> Column:
    """How many keywords occur, as substrings, in an already lower-cased text.

    `found` are those that occur of the keywords of all its items (`found_terms`), where a text meets many; keywords are distinct then.
    """
    return F.size(F.filter(keywords, lambda k: F.contains(low_text, k)) if found is None else F.array_intersect(found, keywords))


def coverage(keywords: Column, low_text: Column, found: Column | None = None) -> Column:
    return ratio_or_zero(keyword_hits(keywords, low_text, found), F.size(keywords))


def _make_found():
    # nested, so that it ships by value and workers need not import this package
    def found(low_text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([[k for k in ks if k in t] if t is not None and ks is not None else [] for t, ks in zip(low_text, terms, strict=True)], dtype=object)

    return F.pandas_udf(found, "array<string>").asNondeterministic()


def found_terms(terms: Column, low_text: Column) -> Column:
    """Which terms occur, as substrings, in an already lower-cased text. Python looks through a text several times as fast as `contains`."""
    return _make_found()(low_text, terms)


# --- overlap signals -------------------------------------------------------------------

def model_tokens(c: Column) -> Column:
    """Upper-case alphanumeric tokens of three or more characters, as in model numbers."""
    return F.filter(words(F.upper(c)), lambda w: w.rlike("^[A-Z0-9]{3,}$"))


def structural_overlap(description: Column, text: Column, theirs: Column | None = None) -> Column:
    """Share of the description's model tokens in the text; `theirs` are the text's own, or those of them that count, where they are known."""
    mine = model_tokens(description)
    return 100 * ratio_or_zero(F.size(F.array_intersect(model_tokens(text) if theirs is None else theirs, mine)), F.size(mine))


def word_overlap(low_description: Column, low_text: Column, sample: int | None = None, theirs: Column | None = None) -> Column:
    """Share of the description's words in the text, or in its first `sample` characters; `theirs` are the text's own, or those of them that count, where they are known."""
    mine = F.array_distinct(split_words(low_description))
    if theirs is None:
        theirs = split_words(low_text if sample is None else F.substring(low_text, 1, sample))
    return 100 * ratio_or_zero(F.size(F.array_intersect(theirs, mine)), F.size(mine))


def phrases(low_description: Column) -> Column:
    """Comma-separated phrases of more than five characters."""
    return F.filter(F.transform(F.split(low_description, ","), strip), lambda p: F.length(p) > 5)


def exact_phrase(low_description: Column, low_text: Column, found: Column | None = None) -> Column:
    """Some comma-separated phrase of more than five characters occurs in the text; `found` as in `keyword_hits`, with the phrases looked for."""
    searched = F.exists(phrases(low_description), lambda p: F.contains(low_text, p))
    return searched if found is None else F.when(low_text.isNotNull(), F.arrays_overlap(found, phrases(low_description))).otherwise(searched)


# --- keyword learning --------------------------------------------------------------------

def learning_tokens(description: Column) -> Column:
    """Candidate keywords of a description, repeats kept."""
    text = F.regexp_replace(F.lower(description), "(?U)" + rules.MODEL_PATTERN, "")
    text = F.regexp_replace(text, "(?U)" + rules.MEASURE_PATTERN, "")
    edge = r"[.,;:()\[\]{}\"'\-]"
    bare = F.transform(split_words(text), lambda w: F.regexp_replace(w, f"^{edge}+|{edge}+$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= 3)
                    & ~w.isin(*rules.STOPWORDS, *rules.UNITS)
                    & ~w.rlike(r"^\p{Nd}+[a-z]*$"))


def technical_context(low_description: Column) -> Column:
    return contains_any(low_description, rules.TECHNICAL_CONTEXT)


def keyword_weight(keyword: Column, technical: Column) -> Column:
    """Confidence of one sighting of a keyword; `technical` marks its description."""
    n = F.length(keyword)
    weight = (F.when(technical, 1.5).otherwise(1.0)
              * F.when(keyword.isin(*rules.COMMON_NOUNS), 0.5).otherwise(1.0)
              * F.when((n > 8) & contains_any(keyword, rules.COMPOUND_PARTS), 1.3).otherwise(1.0)
              * F.when(n < 4, 0.7).when(n > 20, 0.8).otherwise(1.0))
    return F.least(weight, F.lit(3.0))


def keyword_verdict(keyword: Column) -> Column:
    """struct(valid, reason): the ordered accept and reject rules for a new keyword."""
    n = F.length(keyword)

    def says(valid: bool, reason: str) -> Column:
        return F.struct(F.lit(valid).alias("valid"), F.lit(reason).alias("reason"))

    return (F.when(n < 3, says(False, "Too short"))
            .when(keyword.isin(*rules.UNITS), says(False, "Measurement unit"))
            .when((n > 6) & keyword.rlike(r"^[a-z0-9\-]{2,}$"), says(False, "Model number pattern"))
            .when(keyword.rlike(r"^\p{Nd}+[a-z]*$"), says(False, "Number pattern"))
            .when(keyword.isin(*rules.STOPWORDS), says(False, "Common stopword"))
            .when(contains_any(keyword, rules.TECHNICAL_PARTS), says(True, "Technical term"))
            .when((n >= 4) & (n <= 15), says(True, "Valid keyword"))
            .otherwise(says(False, "Failed validation")))
