"""Column functions that bring names, numbers, dates and texts to comparable forms.

All of them give null for null and never raise on dirty text.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats tried when values are compared, day first, with the layout each must have.
COMPARE_FORMATS = (
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("MMMM d, yyyy", r"(?i)^(january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}, \d{4}$"),
)
# Date formats that the validator accepts.
VALIDATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
    ("M-d-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
    ("MMMM d, yyyy", COMPARE_FORMATS[4][1]),
    ("MMM d, yyyy", r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) \d{1,2}, \d{4}$"),
)


#: White space of any kind.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_RUN = f"[{WHITE}]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Stripped, with runs of white space as one blank."""
    return F.regexp_replace(strip(text), WHITE_RUN, " ")


def normalize_name(name: Column) -> Column:
    """Stripped, lower case, blanks and hyphens as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), f"[{WHITE}-]+", "_"), "_+", "_")


#: The decimal digits of all scripts but ASCII's, and what they stand for.
DIGITS = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None)
PLAIN_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def parse_number(text: Column) -> Column:
    """The number in a text with currency signs, thousands commas or accounting brackets, else null.

    Brackets count only where they stand at both ends once signs and commas are gone: a blank left outside of them makes it no number.
    """
    plain = F.translate(strip(text), DIGITS + "$€฿,", PLAIN_DIGITS)
    plain = strip(F.regexp_replace(plain, r"(?s)^\((.*)\)$", "-$1"))
    plain = F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")
    # One pattern lets through what is a number; whatever else a cast might take gives an empty text and so null.
    number = r"(?i)^([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan))$"
    return F.regexp_extract(plain, number, 1).try_cast("double")


def parse_date(text: Column, formats: tuple = COMPARE_FORMATS) -> Column:
    """The date of the first format that fits; two-digit years from 69 on belong to the last century."""
    plain = squeeze(text)
    tried = []
    for layout, shape in formats:
        day = F.try_to_timestamp(F.when(plain.rlike(shape), plain), F.lit(layout)).cast("date")
        if layout.endswith("yy") and not layout.endswith("yyyy"):
            day = F.when(F.regexp_extract(plain, r"(\d{2})$", 1) >= "69", F.add_months(day, -1200)).otherwise(day)
        tried.append(day)
    return F.coalesce(*tried)


def same_text(a: Column, b: Column) -> Column:
    """Equal without regard to case and to the amount of white space."""
    return F.lower(squeeze(a)) == F.lower(squeeze(b))


def file_stem(name: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r".(\.[^.]*)$", 1))


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.floor(share * 100 + 0.5)


def truncate(text: Column, limit: int = 500) -> Column:
    """A long text cut to `limit` characters with a note of its length."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("… [truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))).otherwise(text)


def display(value: Column) -> Column:
    """A value's text, and a dash for null."""
    return F.coalesce(value, F.lit("—"))


def scalar_text(value_json: Column) -> Column:
    """The text of a JSON scalar, of a string without its quotes; null for JSON null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")


def is_container(value_json: Column) -> Column:
    return strip(value_json).rlike(r"^[\[{]")


def is_text(value_json: Column) -> Column:
    return strip(value_json).startswith('"')
