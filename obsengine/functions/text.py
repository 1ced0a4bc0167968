"""Column functions on text: tokens, n-grams, overlaps, gates, routing, escaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval ignores. Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "near", "of", "or", "so", "that", "the", "to", "where", "with",
)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def without(words: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """words without stop words, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def ngrams(words: Column, n: int) -> Column:
    """The set of n-grams as space-joined strings, empty for fewer than n words. Shifted copies are zipped, in linear time."""
    grams = words
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty ones have none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(answer: Column, context: Column, n: int = 3) -> Column:
    """Share of the answer's distinct n-grams that the context has; 1 for an answer too short to have any."""
    mine = ngrams(answer, n)
    return F.when(F.size(answer) < n, 1.0).otherwise(F.size(F.array_intersect(mine, ngrams(context, n))) / F.size(mine).cast("double"))


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-cased text has any of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(text), F.lit(p))
    return F.coalesce(found, F.lit(False))


def routed(text: Column, routes: Mapping[str, Sequence[str]]) -> Column:
    """The first route any of whose terms is in the text; else null."""
    return F.coalesce(*(F.when(mentions(text, terms), F.lit(name)) for name, terms in routes.items()))


def failures(gates: Mapping[str, Column]) -> Column:
    """Names of the gates whose condition (true: failed) holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in gates.items())), lambda x: x.isNotNull())


def safe_id(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))


def html_escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
