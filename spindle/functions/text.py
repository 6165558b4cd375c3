"""Text predicates and tokenisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character that Python's str.strip() keeps: not Unicode white space and not the
# information separators U+001C..U+001F (which Python counts as white space, Java does not).
_NON_BLANK = r"(?U)[^\s\x1c-\x1f]"
# A word is a maximal run of letters, after lower-casing.
WORD_PATTERN = r"\p{L}+"


def non_blank(c: Column | str) -> Column:
    """True when the text has a character other than white space; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(_NON_BLANK)


def word_tokens(c: Column | str) -> Column:
    """Lower-cased letter runs of a text, in order; NULL text gives NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), 0)


def keyword_language(c: Column | str) -> Column:
    """Language code for keyphrase extraction: kept when exactly two characters, else 'en'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) == 2, c).otherwise(F.lit("en"))
