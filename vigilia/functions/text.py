"""Text, number and code expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

MAX_SEQ = 9223372036854775807


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text(col) -> Column:
    return _c(col).cast("string")


def blank_to_null(col) -> Column:
    """Trimmed text, with blank as null."""
    return F.nullif(F.trim(text(col)), F.lit(""))


def is_blank(col) -> Column:
    return blank_to_null(col).isNull()


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def num_br(col, thousands: bool = False) -> Column:
    """Decimal-comma text to double; with ``thousands`` dots are dropped first. Bad text gives null."""
    value = F.trim(text(col))
    if thousands:
        value = F.replace(value, F.lit("."), F.lit(""))
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def int_or(col, default: int | None = None) -> Column:
    """Text to bigint; a decimal part is rounded half up; bad text gives ``default``."""
    value = F.trim(text(col))
    number = F.coalesce(
        value.try_cast("bigint"),
        value.try_cast("decimal(38,10)").try_cast("decimal(28,0)").try_cast("bigint"),
    )
    return number if default is None else F.coalesce(number, F.lit(default).cast("bigint"))


def event_number(df) -> Column:
    """Event number with fallbacks, first non-blank of those the frame has."""
    have = [c for c in ("NUM_SEQ_INTRP", "PID_INTRP_CONJTO_PIN", "NUM_INTRP_UCI") if c in df.columns]
    return first_nonblank(*have)


def region(sigla, origem, default: str = S.COMPANY) -> Column:
    """Region code from a one-letter or three-letter code; the own code wins over the file's."""
    code = F.upper(F.trim(F.coalesce(F.nullif(text(sigla), F.lit("")), F.nullif(text(origem), F.lit("")))))
    names = {**{r: r for r in S.REGIONS}, **S.REGION_BY_LETTER}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[code], F.lit(default))  # the code occurs once, however often one region is taken from another


def region_from_file(col, default: str = S.NO_REGION) -> Column:
    """Region from a file name that ends in ``_XXX.CSV`` (upper case only)."""
    code = F.regexp_extract(text(col), r"_([A-Z]{3})\.CSV$", 1)
    return F.when(code.isin(S.REGIONS), code).otherwise(F.lit(default))


def record_key(*cols) -> Column:
    """Display form of the record key; null when a part is null."""
    parts = [text(c) for c in (cols or S.RECORD_KEY)]
    out = parts[0]
    for part in parts[1:]:
        out = F.concat(out, F.lit("|"), part)
    return out


def record_key_slots(*cols) -> Column:
    """Display form that keeps an empty slot for a missing part."""
    return F.concat_ws("|", *[F.coalesce(text(c), F.lit("")) for c in (cols or S.RECORD_KEY)])


def kei(group, level) -> Column:
    """Voltage multiplier of the compensation formula."""
    group, level = _c(group), _c(level)
    return (
        F.when((group == "A") & level.isin(S.KEI_HIGH_LEVELS), F.lit(S.KEI_HIGH))
        .when((group == "A") & level.isin(S.KEI_MEDIUM_LEVELS), F.lit(S.KEI_MEDIUM))
        .when(group == "B", F.lit(S.KEI_LOW))
        .otherwise(F.lit(0))
    )


def protocol_excludes(col) -> Column:
    """A protocol other than blank or ``0`` excludes."""
    return ~F.coalesce(F.trim(text(col)), F.lit("")).isin("", "0")


def net_class(*protocols) -> Column:
    """``Expurgo`` when any protocol excludes, else ``Liquido``."""
    excludes = F.lit(False)
    for p in protocols:
        excludes = excludes | protocol_excludes(p)
    return F.when(excludes, F.lit("Expurgo")).otherwise(F.lit("Liquido"))


def three_way_class(reason, protocol) -> Column:
    """``Ignorar`` when a treatment reason is set, else net by protocol ``0``."""
    reason = F.trim(text(reason))
    return (
        F.when(reason.isNotNull() & ~reason.isin("", "0"), F.lit("Ignorar"))
        .when(F.trim(text(protocol)) == "0", F.lit("Liquido"))
        .otherwise(F.lit("Expurgo"))
    )


def area_one(col) -> Column:
    """Area code up to 6; missing or bad code is false."""
    return F.coalesce(F.trim(text(col)).try_cast("double") <= 6, F.lit(False))


def long_or_short(minutes) -> Column:
    return F.when(_c(minutes) >= 3, F.lit("Longa")).otherwise(F.lit("Curta"))


def band_value(bands: dict, group, level, place, limit) -> Column:
    """Target by voltage class, urban/rural mark and band of the set's limit (``schema.TARGET_BANDS``)."""
    group, level, place, limit = _c(group), _c(level), _c(place), _c(limit)
    out = None
    for (klass, mark), steps in bands.items():
        code, levels = S.VOLTAGE_CLASSES[klass]
        here = (group == code) & (place == mark)
        if levels is not None:
            here = here & level.isin(levels)
        ladder = None
        for upper, value in steps:
            if upper is None:
                ladder = ladder.otherwise(F.lit(value)) if ladder is not None else F.lit(value)
            else:
                test = limit <= upper
                ladder = F.when(test, F.lit(value)) if ladder is None else ladder.when(test, F.lit(value))
        out = F.when(here, ladder) if out is None else out.when(here, ladder)
    return out


def class_value(rules: list, group, level, place) -> Column:
    """Target that depends on voltage class and urban/rural mark only (``schema.CLASS_TARGETS``)."""
    group, level, place = _c(group), _c(level), _c(place)
    out = None
    for code, levels, mark, value in rules:
        here = group == code
        if levels is not None:
            here = here & level.isin(levels)
        if mark is not None:
            here = here & (place == mark)
        out = F.when(here, F.lit(value)) if out is None else out.when(here, F.lit(value))
    return out
