"""The canonical spelling of finding keys, shared by the collapsing of formatting duplicates and the choice of survivors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and punctuation separate words (Unicode categories Z and P and the control white space), but a punctuation
#: mark directly between two digits is part of the word.
SEPARATORS = r"(?:[\p{Z}\t-\r\x1c-\x1f\x85]|(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd}))+"
#: Joins the canonical parts; a control character that is itself never part of a word's text after separation.
PART = "\u0001"


def canonical_words(value: Column) -> Column:
    """The words of a value in order, in one letter case, one space apart; '' for null and for values without words.

    Case goes up and down again, so that letters with more than one small form meet (long s, final sigma); sharp s is ss.
    """
    spaced = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SEPARATORS, " ")
    return F.replace(F.trim(F.lower(F.upper(spaced))), F.lit("ß"), F.lit("ss"))


def canonical_key(*values: Column) -> Column:
    """One string for the canonical words of several values, each in its place."""
    return F.concat_ws(PART, *(canonical_words(v) for v in values))
