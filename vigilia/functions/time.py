"""Time expressions over timestamps without zone (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DMY = "d/M/yyyy H:m:s"
ISO = "yyyy-M-d H:m:s"
DMY_MINUTE = "d/M/yyyy H:m"
ISO_MINUTE = "yyyy-M-d H:m"

# The text each format fits, and what a plain cast takes besides: a full ISO date with optional time and fraction.
_FITS = {
    DMY: r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}",
    ISO: r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}",
    DMY_MINUTE: r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}",
    ISO_MINUTE: r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}",
}
_NATIVE = r"\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?)?"


def parse_ts(col, formats=(DMY, ISO), native: bool = True) -> Column:
    """Text to timestamp without zone by whichever format fits, else null.

    The formats are disjoint, so their order does not matter. Text that fits one is brought into ISO order and
    cast, which costs a fraction of parsing by pattern; text that fits none is never tried. The column occurs once, so that a
    time made of other columns, or one that a filter asks for, is worked out once and stays short code.
    """
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    fits = "^(?:" + "|".join([*(_FITS[f] for f in formats), *([_NATIVE] if native else [])]) + ")$"
    return F.regexp_replace(F.regexp_extract(text, fits, 0), r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$2-$1").try_cast("timestamp_ntz")


#: Times are told by their distance from here, which is never negative, so that cutting it off rounds down.
_START = "0001-01-01 00:00:00"
_SECONDS_TO_1970 = 62135596800


def second_index(ts) -> Column:
    """Seconds since 1970-01-01 00:00:00, floored; independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    since = ts.cast("timestamp_ntz") - F.lit(_START).cast("timestamp_ntz")
    return since.cast("interval second").cast("long") - F.lit(_SECONDS_TO_1970)


def minute_index(ts) -> Column:
    """Minutes since 1970-01-01 00:00, floored; independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    since = ts.cast("timestamp_ntz") - F.lit(_START).cast("timestamp_ntz")
    return since.cast("interval minute").cast("long") - F.lit(_SECONDS_TO_1970 // 60)


def microsecond_index(ts) -> Column:
    """Microseconds since 1970-01-01; independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return minute_index(ts) * F.lit(60000000) + (F.date_part(F.lit("SECOND"), ts) * F.lit(1000000)).cast("long")


def minute_boundaries(ini, fim) -> Column:
    """Number of minute marks crossed: 10:00:59 to 10:01:00 is 1."""
    return minute_index(fim) - minute_index(ini)


def elapsed_minutes(ini, fim) -> Column:
    """Elapsed whole seconds as minutes (double)."""
    return (second_index(fim) - second_index(ini)).cast("double") / F.lit(60.0)


def plus_hours(ts, hours: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def dmy_text(ts) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


def iso_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def month_bounds(anomes: str) -> tuple[Column, Column]:
    """First instant of a ``YYYYMM`` month and of the next one."""
    text = str(anomes).strip()
    if len(text) != 6 or not text.isdigit() or not 1 <= int(text[4:]) <= 12:
        raise ValueError(f"month must be YYYYMM, got {anomes!r}")
    year, month = int(text[:4]), int(text[4:])
    following = (year + 1, 1) if month == 12 else (year, month + 1)
    first = F.lit(f"{year:04d}-{month:02d}-01 00:00:00").cast("timestamp_ntz")
    last = F.lit(f"{following[0]:04d}-{following[1]:02d}-01 00:00:00").cast("timestamp_ntz")
    return first, last
