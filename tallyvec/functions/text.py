"""Column expressions for tokenising text and building subwords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of the input format (Unicode whitespace and the four
# separator control characters), as a character range list and as single characters.
OTHER_WHITESPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE_RANGES = OTHER_WHITESPACE + " "
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace."""
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def split_words(text: Column) -> Column:
    """Split on runs of whitespace; blank text gives an empty array."""
    # Text whose only white space is the space, which is most of it, is split without a pattern.
    plain = ~text.rlike(f"[{OTHER_WHITESPACE}]")
    words = F.when(plain, F.split(text, " ")).otherwise(F.split(text, f"[{WHITESPACE_RANGES}]+"))
    return F.array_remove(words, "")


def split_pieces(text: Column, separator: str) -> Column:
    """Split on a literal separator and drop the empty pieces."""
    return F.array_remove(F.split(text, re.escape(separator)), "")


def subwords(term: Column, min_n: int = 3, max_n: int = 6) -> Column:
    """``<term>`` followed by its character n-grams by length, then by start."""
    marked = F.concat(F.lit("<"), term, F.lit(">"))
    length = F.length(marked)
    grams = F.transform(
        F.sequence(F.lit(min_n), F.lit(max_n)),
        lambda n: F.when(
            n <= length,
            F.transform(F.sequence(F.lit(1), length - n + 1), lambda b: F.substring(marked, b, n)),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.concat(F.array(marked), F.flatten(grams))
