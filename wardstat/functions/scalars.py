"""Scalar column functions (``Column -> Column``).

All are compositions of built-in ``pyspark.sql.functions`` so they stay
inside whole-stage code generation; none is a Python UDF.  Under ANSI mode
(the Spark 4 default) every parse or cast that may meet bad text uses the
``try_*`` form, which yields NULL instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Target values counted as a positive outcome by the upload job:
POSITIVE_TARGET_VALUES = ["Yes", "True", "1", "Abnormal", "Emergency", "Urgent"]
# Day-type labels of the weekend job:
WEEKEND_LABEL = "Weekend"
WEEKDAY_LABEL = "Weekday"
# Vital-sign anomaly rule: strict comparisons and the defaults used when a
# reading is missing.
HEART_RATE_LIMIT = 120.0
OXYGEN_FLOOR = 90.0
HEART_RATE_DEFAULT = 0.0
OXYGEN_DEFAULT = 100.0
# Oxygen level bounds of the vitals producer.
OXYGEN_MIN = 85.0
OXYGEN_MAX = 100.0
# Hospital code format: prefix and zero-padded width.
HOSPITAL_ID_PREFIX = "HOSP_"
HOSPITAL_ID_WIDTH = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value) -> Column:
    """``value`` computed once per row (as a column of a ``select``): filters
    on a plain column are moved below it, where every mention of the column
    becomes the whole expression again; they stay above an exploded one."""
    return F.explode(F.array(_c(value)))


# --- text -----------------------------------------------------------------

def split_fields(line, sep: str = ",") -> Column:
    """Split a delimited line into an array of fields.

    A trailing run of empty fields is dropped first, as the line-oriented
    jobs did (``a,b,,`` has two fields, ``,,`` has none, an empty line has
    one empty field), so that field-count filters keep their meaning.
    """
    if len(sep) == 1:
        stripped = F.rtrim(_c(line), F.lit(sep))   # no regex for one character
    else:
        stripped = F.regexp_replace(_c(line), f"({_escape(sep)})+$", "")
    only_seps = (F.length(_c(line)) > 0) & (F.length(stripped) == 0)
    return F.when(only_seps, F.array().cast("array<string>")).otherwise(F.split(stripped, _escape(sep)))


def _escape(sep: str) -> str:
    return "".join("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch for ch in sep)


def field(arr, i: int) -> Column:
    """0-based field ``i`` of an array, NULL when absent (never raises)."""
    return F.get(_c(arr), i)


def concat_key(*cols, sep: str = "|") -> Column:
    """``a|b|c`` composite key.  NULL parts become the text ``null`` (as
    string concatenation in the line-oriented jobs did) instead of being
    skipped."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("null")) for c in cols])


def equals_ignore_case(a, b: str) -> Column:
    return F.lower(_c(a)) == F.lit(b.lower())


def year_prefix(c) -> Column:
    """First four characters of the text form of a value."""
    return F.substring(_c(c).cast("string"), 1, 4)


def pad_id(n, prefix: str = HOSPITAL_ID_PREFIX, width: int = HOSPITAL_ID_WIDTH) -> Column:
    return F.format_string(f"{prefix}%0{width}d", _c(n))


# --- flags ----------------------------------------------------------------

def flag(c, value: str = "Yes", ignore_case: bool = False) -> Column:
    """1 when the column equals ``value`` (optionally ignoring case), else 0.
    NULL counts as 0."""
    cond = equals_ignore_case(c, value) if ignore_case else (_c(c) == F.lit(value))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def flag_in_set(c, values: Iterable[str] = tuple(POSITIVE_TARGET_VALUES)) -> Column:
    """1.0 when a text value is in the set, else 0.0 (NULL -> 0.0)."""
    return F.when(_c(c).isin(list(values)), F.lit(1.0)).otherwise(F.lit(0.0))


def cast_double(c) -> Column:
    """Cast to double; unparsable values become NULL instead of failing."""
    return _c(c).try_cast("double")


# --- dates ------------------------------------------------------------------

def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict date parse; NULL on bad text.  The pattern is always passed:
    without one Spark accepts ``2021-1-5`` and ``2021``."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def date_of(df, name: str, fmt: str = "yyyy-MM-dd") -> Column:
    """Column ``name`` of ``df`` as a DATE: used as is when it already is
    one (parsing its own text form is a no-op), strictly parsed otherwise."""
    from pyspark.sql import types as T
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    return parse_date(name, fmt)


def day_type(date_col) -> Column:
    """``Weekend`` for Saturday/Sunday, else ``Weekday``; NULL for NULL."""
    d = _c(date_col)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.weekday(d) >= 5, F.lit(WEEKEND_LABEL))
            .otherwise(F.lit(WEEKDAY_LABEL)))


def year_of(c) -> Column:
    return F.year(_c(c)).cast("int")


def format_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(c), fmt)


def date_plus_days(c, n) -> Column:
    return F.date_add(_c(c), _c(n) if not isinstance(n, int) else F.lit(n))


# --- numbers ----------------------------------------------------------------

def ratio(num, den) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def round_n(c, n: int) -> Column:
    return F.round(_c(c), n)


def format_rate(total, positives, rate) -> Column:
    """``total,positives,rate`` with the rate to four places (NULL if any
    part is NULL).  Java-style formatting (half-up on the shortest decimal
    form), as the line-oriented jobs produced it."""
    parts = [_c(total), _c(positives), _c(rate)]
    ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(ok, F.format_string("%d,%d,%.4f", *parts))


def format_thousands(n) -> Column:
    """``60000`` -> ``60,000``."""
    return F.format_number(_c(n), 0)


def format_fixed(x, places: int) -> Column:
    """A double as text with ``places`` decimals, rounded like Python's
    ``f"{x:.1f}"`` and C's printf: the exact binary value, ties to even
    (``31.25`` -> ``31.2``, ``24.65`` -> ``24.6``).  ``format_string``
    would round the shortest decimal form half-up instead (``31.3``,
    ``24.7``).  No thousands separators; NULL stays NULL."""
    return F.regexp_replace(F.format_number(_c(x), places), ",", "")


def format_pct(x, places: int = 1) -> Column:
    """A fraction as a percentage text, ``0.1234`` -> ``12.3%`` (rounded as
    ``format_fixed``); NULL stays NULL (``format_string`` alone would print
    a truncated ``null``)."""
    v = _c(x)
    return F.when(v.isNotNull(), F.concat(format_fixed(v * F.lit(100.0), places), F.lit("%")))


def clamp(c, lo: float = OXYGEN_MIN, hi: float = OXYGEN_MAX) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), _c(c)))


def fill_default(c, default) -> Column:
    return F.coalesce(_c(c), F.lit(default))


# --- vitals -----------------------------------------------------------------

def anomaly(heart_rate, oxygen_level) -> Column:
    """heart_rate > 120 or oxygen_level < 90, with a missing heart rate read
    as 0 and a missing oxygen level as 100 (so missing never alarms)."""
    hr = fill_default(heart_rate, HEART_RATE_DEFAULT)
    ox = fill_default(oxygen_level, OXYGEN_DEFAULT)
    return (hr > F.lit(HEART_RATE_LIMIT)) | (ox < F.lit(OXYGEN_FLOOR))
