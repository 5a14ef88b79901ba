"""Column expressions over supplier names and document file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions.text import SPACE, contains_any, strip


# --- supplier names -----------------------------------------------------------------

def clean_name(c: Column) -> Column:
    """Drop merge artefacts and normalise whitespace; null stays null, blank becomes ''."""
    out = strip(c)
    for pattern in (rules.USE_CODE_SUFFIX, rules.USE_CODE_PARENS,
                    rules.LEADING_ASTERISKS, rules.TRAILING_ASTERISKS):
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, f"{SPACE}+", " "))


def name_issues(c: Column) -> Column:
    """Tags of the artefacts found in a name, in rule order."""
    name = strip(c)
    checks = [("use_code_suffix", rules.USE_CODE_SUFFIX),
              ("use_code_parens", rules.USE_CODE_PARENS),
              ("leading_asterisks", rules.LEADING_ASTERISKS),
              ("trailing_asterisks", rules.TRAILING_ASTERISKS)]
    return F.array_compact(F.array(*[F.when(name.rlike(p), F.lit(tag)) for tag, p in checks]))


def strip_suffixes(c: Column, mode: str = "anywhere") -> Column:
    """Lower-case a company name and take off its legal suffixes.

    `anywhere` replaces each URL-scoring suffix wherever it occurs, also inside words;
    `anchored` takes one suffix off the end and one prefix off the start.
    """
    out = F.lower(c)
    if mode == "anywhere":
        for suffix in rules.URL_NAME_SUFFIXES:
            out = F.replace(out, F.lit(suffix), F.lit(""))
        return out
    if mode == "anchored":
        # no suffix is the tail of another one, so an alternation equals first-hit order
        out = strip(F.regexp_replace(out, "(?:" + "|".join(rules.COMPANY_SUFFIXES) + r")\z", ""))
        return strip(F.regexp_replace(out, "^(?:" + "|".join(rules.COMPANY_PREFIXES) + ")", ""))
    raise ValueError(f"unknown suffix mode: {mode}")


# --- file names ---------------------------------------------------------------------------

def file_stem(c: Column) -> Column:
    """Name without its last extension; leading dots do not start one."""
    return F.regexp_replace(c, r"^(.*[^.].*)\.[^.]*$", "$1")


def normalize_file_name(c: Column) -> Column:
    """Fold versions, years and status words so that copies of a document share a key."""
    out = file_stem(F.lower(c))
    for pattern in (r"[_\-\s]*\([0-9]+\)", r"[_\-\s]*v[0-9]+", r"[_\-\s]*20[0-9]{2}",
                    r"[_\-\s]*(?:updated|final|revised|new|latest)$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"[_\-\s]+", "_")
    return F.coalesce(F.regexp_replace(out, r"^[_\-. ]+|[_\-. ]+$", ""), F.lit(""))


def _priority_chain(c: Column, pick) -> Column:
    name = F.lower(c)
    out = None
    for category, score, patterns in rules.PRIORITY_RULES:
        hit = name.rlike("|".join(patterns))
        value = F.lit(pick(category, score))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(pick(*rules.DEFAULT_PRIORITY)))


def doc_category(c: Column) -> Column:
    return _priority_chain(c, lambda category, score: category)


def doc_priority(c: Column) -> Column:
    return _priority_chain(c, lambda category, score: score)


def name_sign(c: Column) -> Column:
    """+50 for instruction-like names, -50 for commercial ones, 0 otherwise."""
    name = F.lower(F.coalesce(c, F.lit("")))
    return (F.when(contains_any(name, rules.POSITIVE_NAME_PARTS), 50.0)
            .when(contains_any(name, rules.NEGATIVE_NAME_PARTS), -50.0)
            .otherwise(0.0))


def is_input_name(c: Column, suffixes: tuple[str, ...] = (".xls", ".xlsx")) -> Column:
    """Names worth processing: right suffix, no lock file, not already an output."""
    suffix = F.lower(F.regexp_extract(c, r"[^.].*(\.[^.]*)$", 1))
    return suffix.isin(*suffixes) & ~c.startswith("~$") & ~file_stem(c).endswith("_labeled")
