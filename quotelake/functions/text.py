"""Column expressions over article text."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(column: Column) -> Column:
    """Keep an expensive column from being computed again in later filters.

    Spark moves a filter below the projection that computes its input and
    repeats the expression there, once per use. It does not do so across a
    generator, so the value goes through one that gives exactly one row.
    """
    return F.explode(F.array(column))


def article_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def _check(match):
    if match not in ("substring", "word"):
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")
    return match == "word"


def _whole_words(terms) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


def count_terms(text: Column, terms, match="substring") -> Column:
    """How many different terms occur, not how often.

    ``substring`` finds a term anywhere, ``word`` only as a whole word; all
    words are looked for in one pass over the text.
    """
    if _check(match):
        return F.size(found_terms(text, terms, match))
    return reduce(add, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def any_term(text: Column, terms, match="substring") -> Column:
    if _check(match):
        return text.rlike(_whole_words(terms))
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms])


def found_terms(text: Column, terms, match="substring") -> Column:
    """The terms that occur, in list order."""
    if _check(match):
        hits = F.regexp_extract_all(text, F.lit(_whole_words(terms)), F.lit(0))
        return F.array_intersect(F.array(*[F.lit(t) for t in terms]), hits)
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def polarity(positive: Column, negative: Column) -> Column:
    """Share of positive minus share of negative hits, 0 without hits."""
    total = positive + negative
    return F.when(total == 0, F.lit(0.0)).otherwise((positive - negative).cast("double") / total)


def shorten(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
