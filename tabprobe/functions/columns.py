"""Column builders: pure ``Column -> Column`` functions (no Python UDFs).

Everything here compiles to Catalyst expressions, so it stays inside
whole-stage codegen and is pushed/pruned like any built-in expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.sources.io import col as _col


def _c(x: Column | str) -> Column:
    return _col(x) if isinstance(x, str) else x


# ── flags, recodes, fills ────────────────────────────────────────────────

def flag(cond: Column) -> Column:
    """Boolean → 0/1 int where NULL counts as False (pandas mask semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Dictionary recode via a literal map; unmapped values give ``default``."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, _c(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def fill_null(c: Column | str, value) -> Column:
    return F.coalesce(_c(c), F.lit(value))


# ── binning (pandas ``cut``: right-closed, left-open, out of range NULL) ──

def interval_labels(edges: Sequence[float]) -> list[str]:
    """Labels ``'(a, b]'`` as pandas prints interval categories."""
    def fmt(v):
        return str(int(v)) if float(v).is_integer() else str(v)
    return [f"({fmt(a)}, {fmt(b)}]" for a, b in zip(edges[:-1], edges[1:])]


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None,
        right: bool = True) -> Column:
    """Label of the bucket containing the value, NULL outside ``(e0, eN]``."""
    labels = list(labels) if labels is not None else interval_labels(edges)
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def cut_ordinal(c: Column | str, edges: Sequence[float], right: bool = True) -> Column:
    """0-based bucket number matching :func:`cut` (NULL outside)."""
    x = _c(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def regular_edges(start: float, stop: float, step: float) -> list[float]:
    """``range(start, stop, step)`` edges."""
    out, v = [], start
    while v < stop:
        out.append(v)
        v += step
    return out


# ── arithmetic features ──────────────────────────────────────────────────

def ratio(num: Column | str, den: Column | str, den_offset: float = 0.0) -> Column:
    """num / (den + offset); NULL instead of an error on a zero divisor."""
    d = _c(den) + F.lit(den_offset) if den_offset else _c(den)
    return F.try_divide(_c(num), d)


def log1p_guarded(c: Column | str) -> Column:
    """log1p(x) for x >= 0, else 0 (NULL input also gives 0)."""
    x = _c(c)
    return F.when(x >= 0, F.log1p(x)).otherwise(F.lit(0.0))


def concat_key(a: Column | str, b: Column | str, sep: str = "_", null_text: str = "nan") -> Column:
    """``a + sep + str(b)``; a NULL ``b`` is written as ``'nan'``."""
    return F.concat(_c(a).cast("string"), F.lit(sep), F.coalesce(_c(b).cast("string"), F.lit(null_text)))


def years_since(year: Column | str, as_of_year: int) -> Column:
    return F.lit(as_of_year) - _c(year)


# ── time ─────────────────────────────────────────────────────────────────

def weekday_mon0(ts: Column | str) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def date_parts(ts: Column | str, prefix: str = "") -> list[Column]:
    t = _c(ts)
    return [
        F.hour(t).alias(f"{prefix}hour"),
        F.weekday(t).alias(f"{prefix}weekday"),
        F.dayofmonth(t).alias(f"{prefix}day"),
        F.year(t).alias(f"{prefix}year"),
        F.month(t).alias(f"{prefix}month"),
    ]


def month_period(ts: Column | str) -> Column:
    """``'YYYY-MM'`` month period text."""
    return F.date_format(_c(ts), "yyyy-MM")


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    """(end - start) in fractional minutes (microsecond precision)."""
    # Parquet timestamps without zone read as TIMESTAMP_NTZ; with the UTC
    # session zone the cast is the identity.
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / F.lit(60_000_000.0)


def hour_of_day(seconds: Column | str, whole: bool = False) -> Column:
    """Elapsed seconds → hour of day; fractional as in the source, or floored."""
    h = F.pmod(_c(seconds) / F.lit(3600.0), F.lit(24.0))
    return F.floor(h).cast("int") if whole else h


def decade_label(year: Column | str) -> Column:
    return F.concat((F.floor(_c(year) / 10) * 10).cast("bigint").cast("string"), F.lit("s"))


# ── text cleaners ────────────────────────────────────────────────────────

# Price texts that mean "free".
FREE_PRICE_TEXTS = ["free", "free to play", "play for free!"]

# Release-date text formats tried in order.
DATE_TEXT_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d MMM, yyyy", "MMM d, yyyy", "yyyy"]


def _drop_digit_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[0-9])_(?=[0-9])", "")


# A plain decimal number: the JVM's cast alone would also read type suffixes such as ``12d``.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


def clean_money_text(c: Column | str) -> Column:
    """Price text → double: free words → 0, strip ``$`` and ``,``, else parse or NULL.

    Only plain decimal numbers parse; infinities count as numbers, NaN as missing."""
    t = F.lower(F.trim(_c(c)))
    # digit-separating underscores ("1_000.5") are part of a number
    bare = F.trim(_drop_digit_underscores(F.regexp_replace(t, r"[$,]", "")))
    infinite = F.regexp_extract(bare, r"^([+-]?)inf(inity)?$", 1)
    num = (F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
           .when(bare.rlike(r"^[+-]?inf(inity)?$"), F.when(infinite == "-", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))
    return F.when(t.isin(FREE_PRICE_TEXTS), F.lit(0.0)).otherwise(num)


def clean_date_text_year(c: Column | str) -> Column:
    """Release-date text in one of several formats → year, else NULL."""
    t = F.trim(_c(c))
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_TEXT_FORMATS])
    return F.year(parsed)


def clean_leading_int(c: Column | str, default: int = 0) -> Column:
    """First whitespace-separated token as a 64-bit int, else ``default``."""
    tok = _drop_digit_underscores(F.get(F.split(F.trim(_c(c)), r"\s+"), 0))
    whole = F.when(tok.rlike(r"^[+-]?[0-9]+$"), tok.try_cast("bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def split_list(c: Column | str, pattern: str = r",\s*") -> Column:
    return F.split(_c(c), pattern)


def normalise_text(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c)))


def percent_label(x: Column | str, decimals: int = 1) -> Column:
    """0.1234 → ``'12.3%'`` (display projection only).

    Rounds half-to-even on the exact binary value, as Python's ``format``
    does (``format_number`` uses DecimalFormat; its grouping commas are
    removed)."""
    txt = F.regexp_replace(F.format_number(_c(x) * 100, decimals), ",", "")
    return F.concat(txt, F.lit("%"))
