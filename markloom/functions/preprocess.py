"""Input preprocessing: drops surrogates, non-characters and controls 7F-9F, then normalises newlines.

Newlines: a CR takes the LF or CR behind it along into one LF; any other CR goes. Dropping comes first, so that a
dropped character between CR and LF doesn't part them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.functions import classes as c

#: Surrogates can't be in a Spark string; a class that names them isn't legal in every regex engine.
DROPPED = c.regex(c.union(c.NON_CHARACTERS, c.CONTROLS))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(DROPPED), F.lit(""))


def error_count(text: Column) -> Column:
    """Number of dropped characters."""
    return F.length(text) - F.length(sanitize(text))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"\r[\r\n]"), F.lit("\n")), F.lit(r"\r"), F.lit(""))


def preprocess(text: Column) -> Column:
    return normalize_newlines(sanitize(text))
