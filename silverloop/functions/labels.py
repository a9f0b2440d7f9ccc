"""Labels, ids and text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as a label, lower case.
POSITIVE_WORDS = ["1", "true", "green", "yes", "y"]
NEGATIVE_WORDS = ["0", "false", "not_green", "no", "n"]

# Number formats. Spark's own double cast also takes "1d" and
# "1f", so text is matched against these before it is cast.
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_TEXT = r"^[+-]?[0-9]+$"

# Fixed value: white space of all Unicode kinds and the ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_INFINITY = float("inf")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_or_empty(c: Column, literal_null: bool = False) -> Column:
    """Text with null as ``""``, or as the word ``None`` with ``literal_null``."""
    return F.coalesce(c.cast("string"), F.lit("None" if literal_null else ""))


def to_number(c: Column) -> Column:
    """Double from dirty text or any number; anything else is null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))


def to_int01(c: Column) -> Column:
    """Label 0/1 from words or numbers; null when neither is recognised.

    Numbers are cut to an integer first, so 1.9 is 1; every integer but 1 is 0.
    """
    word = F.lower(strip(c.cast("string")))
    number = to_number(word)
    return (
        F.when(word.isin(POSITIVE_WORDS), F.lit(1))
        .when(word.isin(NEGATIVE_WORDS), F.lit(0))
        .when(F.abs(number) < _INFINITY, F.when((number >= 1) & (number < 2), 1).otherwise(0))
        .cast("int")
    )


def binary_label(c: Column) -> Column:
    """1 or 0 when the value is exactly that number, else null."""
    number = to_number(c)
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def clean_doc_id(c: Column) -> Column:
    """One text form per document id.

    Numbers become integers, halves rounding to the even neighbour; other text
    keeps its digits only; blank, ``nan`` and ``inf`` are null. Integer text is
    never put through a double, so long ids keep all digits.
    """
    text = strip(c.cast("string"))
    plain = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    rounded = F.bround(text.try_cast("double")).try_cast("decimal(38,0)").cast("string")
    digits = F.regexp_replace(text, r"(?U)\D", "")
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.rlike(INTEGER_TEXT), F.when(plain == "-0", F.lit("0")).otherwise(plain))
        .when(text.rlike(FLOAT_TEXT), rounded)
        .when(digits != "", digits)
    )
