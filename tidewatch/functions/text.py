"""Text clean-up and text-derived features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.numeric import as_column, flag


# Fixed value: every character that counts as whitespace when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def strip_lower(c: Column | str) -> Column:
    return F.lower(strip(c))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def or_unknown(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit("Unknown"))


def text_length(c: Column | str) -> Column:
    return F.length(or_empty(c))


def word_count(c: Column | str) -> Column:
    """Whitespace-separated words; empty and blank text have none.

    Every kind of whitespace is mapped to a blank first, because splitting at a
    fixed character is several times faster than at a pattern.
    """
    blanks = F.translate(or_empty(c), WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.array_remove(F.split(blanks, " "), ""))


def mentions(c: Column | str, *words: str) -> Column:
    """1 when any of the words occurs, whatever the case."""
    lowered = F.lower(or_empty(c))
    found = [lowered.contains(w.lower()) for w in words]
    return flag(reduce(lambda a, b: a | b, found))


def device_flags(c: Column | str) -> dict[str, Column]:
    # The browser and device words behind each flag.
    words = {
        "is_chrome": ("Chrome",),
        "is_firefox": ("Firefox",),
        "is_msie": ("MSIE", "Trident"),
        "is_mobile": ("Mobile", "Android", "iPhone"),
    }
    return {name: mentions(c, *ws) for name, ws in words.items()}
