"""Scalar column functions (F1-F15). All are built-in expressions: they run
inside whole-stage codegen, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook.schema import ROLES

# FIXED VALUES: status -> badge class, keyed by the lower-cased status.
STATUS_CLASSES = {
    "scheduled": "badge-scheduled",
    "requested": "badge-scheduled",
    "completed": "badge-completed",
    "canceled": "badge-canceled",
    "paid": "badge-paid",
    "pending": "badge-pending",
    "unpaid": "badge-unpaid",
    "partial": "badge-partial",
}

DASH = "—"  # shown for a missing value


CI_COLLATION = "UNICODE_CI_AI_RTRIM"


def text_key(x: Column, ci: bool = False) -> Column:
    """A string for comparing and grouping. With ``ci`` it ignores case,
    accents and trailing spaces, like the service database's collation."""
    return F.collate(x, CI_COLLATION) if ci else x


def split_full_name(full_name: Column, fallback: Column | None = None) -> tuple[Column, Column]:
    """(first, last) split at the first space of the trimmed name; last is
    '' without a space. An empty or NULL name gives (fallback, '')."""
    trimmed = F.regexp_replace(full_name, r"^\s+|\s+$", "")
    parts = F.split(trimmed, " ", 2)
    has_name = F.length(F.coalesce(full_name, F.lit(""))) > 0
    first = F.when(has_name, parts.getItem(0))
    last = F.when(has_name, F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    if fallback is not None:
        first = F.coalesce(first, fallback)
        last = F.coalesce(last, F.lit(""))
    return first, last


def hhmm(seconds: Column) -> Column:
    """seconds since midnight -> 'HH:mm'; NULL stays NULL."""
    h = F.floor(seconds / 3600).cast("int")
    m = F.floor((seconds % 3600) / 60).cast("int")
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))


def fmt_money(x: Column) -> Column:
    """'$1,234.50', half cents away from zero; NULL -> an em dash."""
    return F.when(x.isNull(), F.lit(DASH)).otherwise(
        F.concat(F.lit("$"), F.format_number(F.round(x.cast("decimal(38,6)"), 2), 2)))


def fmt_pct(fraction: Column) -> Column:
    """a fraction as '80.0%'; NULL -> an em dash."""
    return F.when(fraction.isNull(), F.lit(DASH)).otherwise(
        F.concat(F.format_string("%.1f", fraction.cast("double") * 100), F.lit("%")))


def fmt_int(x: Column) -> Column:
    """'1,234', rounded half away from zero; NULL -> an em dash."""
    return F.when(x.isNull(), F.lit(DASH)).otherwise(F.format_number(F.round(x.cast("decimal(38,6)"), 0), 0))


_NUMBER_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def parse_lenient(s: Column) -> Column:
    """the leading number of a string as a double, 0 when there is none
    (what a browser's parseFloat(x) || 0 gives)."""
    num = F.regexp_extract(s, _NUMBER_PREFIX, 1)
    return F.coalesce(F.nullif(num, F.lit("")).try_cast("double"), F.lit(0.0))


def parse_strict(s: Column) -> Column:
    """F13, strict: a plain cast (fails under ANSI mode on bad input)."""
    return s.cast("double")


def status_class(status: Column) -> Column:
    """badge class of a status, '' when unknown."""
    m = F.create_map(*[F.lit(x) for kv in STATUS_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.coalesce(status, F.lit("")))), F.lit(""))


def default_if_missing(x: Column, default) -> Column:
    """a default when the value is absent (NULL)."""
    return F.coalesce(x, F.lit(default))


def default_if_empty(x: Column, default: Column | str) -> Column:
    """a default when the value is NULL or ''."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(x, F.lit("")), d)


def role_allowed(role: Column) -> Column:
    """the role is one of the known roles."""
    return role.isin(*ROLES)


def money_out(x: Column) -> Column:
    """Exact decimals stay decimals inside; at the result boundary they leave as doubles."""
    return x.cast("double")
