"""Column-level parsers used by type inference (S-10, S-11, S-12).

All parsers are pure Catalyst expressions (``try_cast`` / ``try_to_timestamp``),
so they stay inside whole-stage codegen and never raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's cleaning rules:
# characters stripped before a numeric parse, the minus signs normalised to
# '-', and the accepted boolean spellings (compared lower-cased).
NUMERIC_STRIP_PATTERN = r"[$,%)(\s]"
MINUS_PATTERN = "[−-]"
TRUE_VALUES = ("true", "yes", "1", "t", "y")
FALSE_VALUES = ("false", "no", "0", "f", "n")

# Datetime formats tried in order when a column is probed (Spark patterns).
DEFAULT_DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    # with a zone: the moment in UTC
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    # day or month first, times, twelve hours, dots
    "dd/MM/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy hh:mm a",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy",
    # month names
    "dd MMM yyyy HH:mm:ss",
    "dd MMM yyyy",
    "dd-MMM-yyyy",
    "dd MMMM yyyy",
    "MMM dd, yyyy",
    "MMMM dd, yyyy",
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Same rule as the two patterns above, as one character translation (no regex):
# the Unicode minus becomes '-', the other listed characters are deleted.
_TRANSLATE_FROM = "−$,%)( \t\n\r\f\u000b"
_TRANSLATE_TO = "-"


def numeric_text(col) -> Column:
    """The text a numeric parse sees: currency, separators, %, parentheses and
    whitespace removed, Unicode minus normalised."""
    return F.translate(_c(col), _TRANSLATE_FROM, _TRANSLATE_TO)


# A cheap shape test in front of every cast: a failed cast costs a JVM
# exception per row, a failed regex match costs nothing.
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_numeric(col) -> Column:
    """S-10: ``'$1,234'`` → 1234.0, ``'(5)'`` → 5.0, ``'5%'`` → 5.0; else null."""
    txt = numeric_text(col)
    return F.when(txt.rlike(NUMBER_SHAPE), txt.try_cast("double"))


def parse_boolean(col) -> Column:
    """S-12: yes/no style text → boolean; anything else → null."""
    low = F.lower(F.trim(_c(col)))
    return (F.when(low.isin(*TRUE_VALUES), F.lit(True))
            .when(low.isin(*FALSE_VALUES), F.lit(False)))


def is_boolean_text(col) -> Column:
    low = F.lower(F.trim(_c(col)))
    return low.isin(*TRUE_VALUES, *FALSE_VALUES)


_FORMAT_TOKENS = (("yyyy", r"\d{4}"), ("MMMM", r"(?i:january|february|march|april|may|june|july|august|september|october|november|december)"),
                  ("MMM", r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"), ("MM", r"\d{1,2}"), ("dd", r"\d{1,2}"),
                  ("HH", r"\d{1,2}"), ("hh", r"\d{1,2}"), ("mm", r"\d{1,2}"), ("ss", r"\d{1,2}"), ("a", r"(?i:am|pm)"),
                  ("XXX", r"(Z|[+-]\d{2}:\d{2})"))


def format_shape(fmt: str) -> str:
    """Regex that every text parsable with the (simple) Spark pattern matches."""
    import re
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        if fmt[i] == "[":  # optional part
            j = fmt.index("]", i)
            out.append("(" + format_shape(fmt[i + 1:j])[1:-1] + ")?")
            i = j + 1
            continue
        if fmt[i] == "S":  # a fraction of at most so many digits
            j = i
            while j < len(fmt) and fmt[j] == "S":
                j += 1
            out.append(rf"\d{{1,{j - i}}}")
            i = j
            continue
        for tok, rx in _FORMAT_TOKENS:
            if fmt.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            out.append(re.escape(fmt[i]))
            i += 1
    return "^" + "".join(out) + "$"


def parse_datetime(col, fmt: str) -> Column:
    """S-11: one format for the whole column; failures become null.

    Month names and AM/PM are read in any case.  A format with a zone gives the
    moment in UTC, whatever the session's zone."""
    c = _c(col)
    text = F.initcap(c) if "MMM" in fmt else F.upper(c) if fmt.endswith(" a") else c
    shape = c.rlike(format_shape(fmt))
    if "XXX" in fmt:
        # the text without its zone is a wall time; the zone's minutes are taken off
        zone = F.regexp_extract(c, r"(Z|[+-]\d{2}:\d{2})$", 1)
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        off = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
        wall = F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:\d{2})$", ""), F.lit(fmt.replace("XXX", ""))).cast("timestamp_ntz")
        return F.when(shape, F.timestamp_add("MINUTE", -off, wall))
    # one-digit days, months and hours are as good as two-digit ones
    loose = fmt.replace("dd", "d").replace("HH", "H").replace("hh", "h") if "MMM" in fmt or fmt.endswith(" a") else fmt
    return F.when(shape, F.try_to_timestamp(text, F.lit(loose)).cast("timestamp_ntz"))
