"""How many intervals of a key a row overlaps, and the best of them, without listing pairs.

Asked is for the overlapping rows with a lower ``order`` number. A key of few rows is one list, in which each row is compared with
the others. In other keys rows that overlap lie in one merged period of the key. In a period of at most ``LIGHT`` rows each is compared with the list of them. In larger ones, among rows with length, those that start
before the row's end less those that end by its start overlap it: two running counts. "Lower order" is read off the binary digits
of the numbers: ``b < a`` when at exactly one digit the numbers agree above it, ``b`` has 0 and ``a`` has 1. So a row gives itself to the
groups (digit, digits above) where it has 0 and asks the groups where it has 1, and every question becomes a running count in
groups of equal prefix.

A row of a large period is at most 64 short rows, as many as its period has differing digits. Nothing grows with the
number of overlaps; a group is cut into cells of the calendar as in ``intervals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import DAY, _before, _cell, _island_of_start, _join_same, _keyed, light_and_heavy, stab_join

_SIGN = -(2**63)
# Rows of a merged period up to which each is compared with the list of them.
LIGHT = 64


def _groups(order: str) -> Column:
    """Array of (level, prefix, asks) of a row; ``_bits`` digits differ in its period, ``_open`` says that it has rows without a number.

    Rows without a number come after all others: level -1 is where those with one give and those without ask.
    """
    digits = F.expr(
        f"transform(if({order} is null or _bits = 0, array(), sequence(0, _bits - 1)), l -> named_struct('level', l,"
        f" 'prefix', if(l = 63, 0L, shiftrightunsigned(_u, l + 1)), 'asks', (shiftrightunsigned(_u, l) & 1L) = 1L))")
    last = F.expr(f"if(_open, array(named_struct('level', -1, 'prefix', 0L, 'asks', {order} is null)), array())")
    return F.concat(digits, last)


def _periods(rows: DataFrame, key: list[str], cell: int) -> DataFrame:
    """Rows in a merged period ``_ilha`` with others, with ``_size``, the number of its rows, and what ``_groups`` asks of it.

    Rows that run backwards count with their times swapped; they lie inside what they overlap.
    """
    spans = rows.withColumns({"_a": F.least("_i", "_f"), "_b": F.greatest("_i", "_f")})
    labelled = _join_same(spans, _island_of_start(spans, key, "_a", "_b", cell), [*key, "_a"]).drop("_a", "_b")
    facts = labelled.groupBy(*key, "_ilha").agg(
        F.count("*").alias("_size"), F.min("_o").alias("_low"), F.max("_o").alias("_high"), (F.count("*") > F.count("_o")).alias("_open"))
    differ = F.coalesce(F.col("_low").bitwiseXOR(F.col("_high")), F.lit(0))
    bits = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))).alias("_bits")
    return labelled.join(facts.select(*key, "_ilha", "_size", "_open", bits).where("_size > 1 AND (_bits > 0 OR _open)"), [*key, "_ilha"])


def _in_small(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, _o, _i, _f, _n, _m) of the rows of small periods, each compared with the list of its period."""
    one = ["_o", "_i", "_f", "_c", "_me"]
    lists = rows.groupBy(*key, "_ilha").agg(F.collect_list(F.struct(*one)).alias("_all"))  # a period or a key of few rows
    asked = lists.select(*key, "_all", F.explode("_all").alias("_x"))
    met = asked.withColumn("_met", F.expr(
        "filter(_all, y -> y._o is not null and (_x._o is null or y._o < _x._o) and y._i < _x._f and _x._i < y._f)"))
    return met.where(F.size("_met") > 0).select(
        *key, "_x._o", "_x._i", "_x._f", F.expr("aggregate(_met, 0L, (n, y) -> n + y._c)").alias("_n"),
        F.array_max(F.transform("_met", lambda y: y["_me"])).alias("_m"))


def _placed(rows: DataFrame, order: str) -> DataFrame:
    """One copy of a row for each group that it gives to or asks (``_asks``)."""
    return rows.withColumn("_u", F.col(order).bitwiseXOR(F.lit(_SIGN))).withColumn("_g", F.explode(_groups(order))).withColumns(
        {"_level": F.col("_g.level"), "_prefix": F.col("_g.prefix"), "_asks": F.col("_g.asks")}).drop("_g", "_u", "_bits", "_open", "_size")


def _facts(given: DataFrame, group: list[str], ini: str, fim: str, cell: int, asked: DataFrame) -> DataFrame:
    """Per group and asked instant: starts before it (``_s``), ends up to it (``_e``), the best row that starts before it (``_m``)."""
    none = F.lit(None).cast(given.schema["_me"].dataType)
    start = F.struct(F.col(ini).alias("_t"), F.col("_c").alias("_s"), F.lit(0).cast("long").alias("_e"), F.col("_me").alias("_m"))
    end = F.struct(F.col(fim).alias("_t"), F.lit(0).cast("long").alias("_s"), F.col("_c").alias("_e"), none.alias("_m"))
    marks = given.select(*group, F.explode(F.array(start, end)).alias("_x")).select(*group, "_x.*")
    marks = marks.unionByName(asked.select(*group, "_t", F.lit(0).alias("_s"), F.lit(0).alias("_e"), none.alias("_m")))
    points = marks.groupBy(*group, "_t").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"), F.max("_m").alias("_m"))
    points = points.withColumn("_cell", _cell("_t", cell))
    cells = points.groupBy(*group, "_cell").agg(F.sum("_s").alias("_cs"), F.sum("_e").alias("_ce"), F.max("_m").alias("_cm"))
    past = _before(group, F.asc("_cell"))
    cells = cells.select(*group, "_cell", *[f(c).over(past).alias(c) for c, f in (("_cs", F.sum), ("_ce", F.sum), ("_cm", F.max))])
    inside = Window.partitionBy(*group, "_cell").orderBy("_t")
    until, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    local = points.select(*group, "_cell", "_t", F.sum("_s").over(until).alias("_s"), F.sum("_e").over(upto).alias("_e"), F.max("_m").over(until).alias("_m"))
    zero = F.lit(0)
    return local.join(cells, [*group, "_cell"]).select(
        *group, "_t", (F.coalesce("_s", zero) + F.coalesce("_cs", zero)).alias("_s"),
        (F.coalesce("_e", zero) + F.coalesce("_ce", zero)).alias("_e"), F.greatest("_m", "_cm").alias("_m"))


def _in_large(rows: DataFrame, key: list[str], cell: int) -> DataFrame:
    """As ``_in_small`` for periods of any size: running counts, and a join of the rows without length with those around them."""
    long, odd = rows.where("_i < _f"), rows.where("_i >= _f")
    placed = _placed(long, "_o")
    group, row = [*key, "_ilha", "_level", "_prefix"], [*key, "_o", "_i", "_f"]
    both = F.explode(F.array(F.struct(F.col("_f").alias("_t"), F.lit(True).alias("_end")), F.struct(F.col("_i").alias("_t"), F.lit(False).alias("_end"))))
    asked = placed.where("_asks").select(*group, "_o", "_i", "_f", both.alias("_x")).select(*group, "_o", "_i", "_f", "_x.*")
    known = _facts(placed.where("NOT _asks"), group, "_i", "_f", cell, asked)
    answer = asked.join(known, [*group, "_t"]).select(
        *row, F.when(F.col("_end"), F.col("_s")).otherwise(-F.col("_e")).alias("_n"), F.when(F.col("_end"), F.col("_m")).alias("_m"))

    around = long.select(*key, "_ilha", *[F.col(c).alias(f"a{c}") for c in ("_o", "_i", "_f", "_c", "_me")])
    met = stab_join(odd, around, [*key, "_ilha"], "_i", "a_i", "a_f").where((F.col("_f") > F.col("a_i")) & (F.col("_i") < F.col("a_f")))
    lower = lambda x, y: x.isNotNull() & (y.isNull() | (x < y))
    loses = met.where(lower(F.col("a_o"), F.col("_o"))).select(*row, F.col("a_c").alias("_n"), F.col("a_me").alias("_m"))
    wins = met.where(lower(F.col("_o"), F.col("a_o"))).select(
        *key, F.col("a_o").alias("_o"), F.col("a_i").alias("_i"), F.col("a_f").alias("_f"), F.col("_c").alias("_n"), F.col("_me").alias("_m"))
    return answer.unionByName(loses).unionByName(wins).groupBy(*row).agg(F.sum("_n").alias("_n"), F.max("_m").alias("_m")).where("_n > 0")


def overlap_counts(df: DataFrame, key: list[str], order: str, ident: str, ini: str = "inicio", fim: str = "fim",
                   cell: int = DAY) -> DataFrame:
    """Rows of ``df`` that overlap a row of their key with a lower ``order``, with their number and the one that ends last.

    Adds ``sobrepostas`` (how many), ``<ident>_sobreposta`` and ``fim_sobreposta`` (of ties in the end the highest ``ident``). Two rows
    overlap when each starts before the other ends. A missing ``order`` comes after all numbers; equal ones, and two
    missing ones, are not lower than each other. Rows without a full key or without times overlap nothing.
    Rows without length, or that run backwards, lie inside those they overlap and never meet one another; they alone are
    joined with the rows around them.
    """
    row = [*key, "_o", "_i", "_f"]
    # Rows alike in key, number and times have the same answer: one of them asks, and as partners they count as many as they are.
    rows = df.where(_keyed(key) & F.col(ini).isNotNull() & F.col(fim).isNotNull()).select(
        *key, F.col(order).cast("long").alias("_o"), F.col(ini).alias("_i"), F.col(fim).alias("_f"),
        F.struct(F.col(fim).alias("f"), F.col(ident).alias("e")).alias("_me")).groupBy(*row).agg(F.count("*").alias("_c"), F.max("_me").alias("_me"))
    few, many = light_and_heavy(materialize(rows, "intervalos"), key)
    found = _in_small(few.withColumn("_ilha", F.lit(0)), key)  # no longer a list than a key has rows
    if many is not None:
        stored = materialize(_periods(many, key, cell), "periodos")  # read to compare, to give and to ask
        light, heavy = stored.where(F.col("_size") <= LIGHT), stored.where(F.col("_size") > LIGHT)
        found = found.unionByName(_in_small(light, key))
        if not heavy.isEmpty():
            found = found.unionByName(_in_large(heavy, key, cell))
    own = {"_o": "_ov_order", "_i": "_ov_start", "_f": "_ov_end", "_n": "_ov_n", "_m": "_ov_m"}
    asker = df.withColumns({"_ov_order": F.col(order).cast("long"), "_ov_start": F.col(ini), "_ov_end": F.col(fim)})
    return _join_same(asker, found.withColumnsRenamed(own), [own.get(c, c) for c in row]).select(
        *df.columns, F.col("_ov_n").alias("sobrepostas"), F.col("_ov_m.e").alias(f"{ident}_sobreposta"), F.col("_ov_m.f").alias("fim_sobreposta"))


def pairs_of(page: DataFrame, df: DataFrame, key: list[str], order: str, ident: str, ini: str = "inicio", fim: str = "fim") -> DataFrame:
    """The rows that those of ``page`` overlap, as ``overlap_counts`` counts them: pairs for the rows of a page, not of the table.

    ``page`` is a part of ``df``; each of its rows comes once for each partner, with ``<ident>_sobreposta``, ``inicio_sobreposta`` and
    ``fim_sobreposta``.
    """
    page = page.drop(f"{ident}_sobreposta", "inicio_sobreposta", "fim_sobreposta")
    others = df.where(F.col(order).isNotNull()).select(
        *key, F.col(order).alias("_bo"), F.col(ident).alias(f"{ident}_sobreposta"), F.col(ini).alias("inicio_sobreposta"), F.col(fim).alias("fim_sobreposta"))
    lower = F.col(order).isNull() | (F.col("_bo") < F.col(order))
    meets = (F.col(ini) < F.col("fim_sobreposta")) & (F.col("inicio_sobreposta") < F.col(fim))
    return page.join(others, key).where(lower & meets).select(*page.columns, f"{ident}_sobreposta", "inicio_sobreposta", "fim_sobreposta")
