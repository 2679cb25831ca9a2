"""Interval operators: merge, containment, trimming, overlap pairs.

All of them work per key (a UC, a device) on a start and an end column, with one plan for keys of any size; a key is never
ranked or listed in one task:

* Running facts such as "latest end so far" need one row per distinct start of a key, which partial aggregation
  produces before the exchange. They are computed per (key, cell), a cell being a stretch of the calendar, and carried over
  from cell to cell through a summary of one row per (key, cell). A cell's group is bounded by the number of distinct
  instants in a cell, the carry by the number of cells.
* Look-ups of a partner go through the running facts (containment) or up and down a tree of cells of bounded fan-out that
  knows the earliest start behind each (trimming); both return one row for each row that asks.
* Overlap pairs, whose result is the pairs themselves, use a grid join: a start is a point in one cell, an
  interval covers a few cells of the width that suits its length, and only pairs that share a cell are compared.

All that is for keys with more than ``LIGHT`` rows. Most keys have a handful: their rows move once, to a list of no more than
that, in which each is compared with the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import MAX_SEQ
from ..functions.time import microsecond_index, minute_boundaries, second_index
from ..session import materialize

DAY = 86400
# Widths of the grid join: each grid is so many times as coarse as the one before.
GRIDS, GRID_STEP = 5, 16
# Children of a cell of the tree at most; the tree has as many levels as the distinct instants of the table ask for.
TREE_STEP = 256
# Rows of a key up to which each is compared with the list of them.
LIGHT = 256


def _cell(ts, width: int) -> Column:
    return F.floor(second_index(ts) / F.lit(width))


def _keyed(key: list[str]) -> Column:
    """Whether a row has a full key; one without matches no other row."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])


def light_and_heavy(df: DataFrame, key: list[str], nulls: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that have at most ``LIGHT`` of them, and those of the other keys, if there are any.

    A row without a full key is light: it meets no other row. With ``nulls`` it meets those with the same nulls, as grouping has it.
    """
    sizes = (df if nulls else df.where(_keyed(key))).groupBy(*key).agg(F.count("*").alias("_n"))
    heavy = materialize(sizes.where(F.col("_n") > LIGHT).select(*key, F.lit(True).alias("_heavy")), "chaves")
    if heavy.isEmpty():
        return df, None
    joined = _join_same(df, heavy, key, "left") if nulls else df.join(heavy, key, "left")
    marked = materialize(joined.select(*df.columns, "_heavy"), "por_chave")
    return marked.where("_heavy IS NULL").drop("_heavy"), marked.where("_heavy").drop("_heavy")


def listed(light: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(key, ``_all``): the rows of each key as a list of structs of the other columns, a row without a full key on its own."""
    alone = F.when(~_keyed(key), F.monotonically_increasing_id())
    rows = light.select(*key, alone.alias("_alone"), F.struct(*(columns or [c for c in light.columns if c not in key])).alias("_row"))
    return rows.groupBy(*key, "_alone").agg(F.collect_list("_row").alias("_all")).drop("_alone")


def _out_of_list(df: DataFrame, key: list[str], row: str) -> list[Column]:
    """The columns of ``df`` where ``listed`` made of it a key and rows, one of which is ``row``."""
    return [F.col(c) if c in key else F.col(row)[c].alias(c) for c in df.columns]


def _join_same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name, nulls equal, as grouping has it."""
    marked = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    return left.join(marked, same, how).drop(*[f"_r_{c}" for c in columns])


def _before(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _carry(cells: DataFrame, key: list[str], value: str, name: str, order: Column, agg) -> DataFrame:
    """Per (key, cell): ``agg`` of ``value`` over the cells that come before it in ``order``."""
    return cells.select(*key, "_cell", agg(value).over(_before(key, order)).alias(name))


def _running(points: DataFrame, key: list[str], at: str, value: str, agg=F.max, inclusive: bool = False) -> DataFrame:
    """Add ``_prev``: ``agg`` of ``value`` over the key's rows with a smaller (or, ``inclusive``, equal) ``at``.

    ``points`` holds one row per (key, at) and a ``_cell`` column derived from ``at``.
    """
    cells = points.groupBy(*key, "_cell").agg(agg(value).alias("_m"))
    carried = _carry(cells, key, "_m", "_carried", F.asc("_cell"), agg)
    window = Window.partitionBy(*key, "_cell").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = agg(value).over(window)
    if agg is F.max:
        both = F.greatest(local, F.col("_carried"))
    else:
        both = F.coalesce(local, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return _join_same(points, carried, [*key, "_cell"]).withColumn("_prev", both).drop("_carried")


def _running_end(starts: DataFrame, key: list[str], ini: str, fim: str) -> DataFrame:
    """Add ``_prev``: the latest end among rows of the key with a smaller start."""
    return _running(starts, key, ini, fim)


def _lookup(values: DataFrame, asked: DataFrame, key: list[str], agg=F.max, inclusive: bool = False, cell: int = DAY) -> DataFrame:
    """(key, _t) of ``asked`` with ``_prev``, the running ``agg`` of ``values`` (key, _t, _v) before ``_t``."""
    neutral = asked.select(*key, "_t").withColumn("_v", F.lit(None).cast(values.schema["_v"].dataType))
    points = values.select(*key, "_t", "_v").unionByName(neutral).groupBy(*key, "_t").agg(agg("_v").alias("_v"))
    return _running(points.withColumn("_cell", _cell("_t", cell)), key, "_t", "_v", agg, inclusive).select(*key, "_t", "_prev")


def overlaps_any(df: DataFrame, others: DataFrame, key: list[str], ini: str = "inicio", fim: str = "fim",
                 name: str = "sobrepoe", cell: int = DAY) -> DataFrame:
    """Flag rows that overlap at least one interval of ``others`` under the same key.

    Some interval overlaps a row when the latest end among those that start before the row's end exceeds the
    row's start: one running maximum, no pairs.
    """
    ends = others.select(*key, F.col(ini).alias("_t"), F.col(fim).alias("_v"))
    before = _lookup(ends, df.select(*key, F.col(fim).alias("_t")), key, cell=cell)
    return df.join(before.withColumnRenamed("_t", fim), [*key, fim], "left").select(
        *df.columns, F.coalesce(F.col("_prev") > F.col(ini), F.lit(False)).alias(name)
    )


def overlaps_other(df: DataFrame, key: list[str], ini: str = "inicio", fim: str = "fim", name: str = "sobrepoe",
                   cell: int = DAY) -> DataFrame:
    """Flag rows that overlap another row of the same key (rows that end before they start included).

    For a row with length: among intervals that do not run backwards, those that start before its end and do
    not end by its start overlap it; two running counts give their number, the row itself included. Backward
    intervals, and rows without length, which never meet themselves, are looked up.
    """
    light, heavy = light_and_heavy(materialize(df, "intervalos"), key)  # read for sizes, rows, starts, ends and both look-ups

    def met(x):
        others = F.size(F.filter("_all", lambda y: (y[ini] < x[fim]) & (x[ini] < y[fim]))) - F.coalesce(x[ini] < x[fim], F.lit(False)).cast("int")
        return F.struct(x.alias("r"), (others > 0).alias("met"))

    alike = listed(light, key).select(*key, F.explode(F.transform("_all", met)).alias("_x")).select(*_out_of_list(light, key, "_x.r"), F.col("_x.met").alias(name))
    return alike if heavy is None else alike.unionByName(_overlaps_counted(heavy, key, ini, fim, name, cell))


def _overlaps_counted(df: DataFrame, key: list[str], ini: str, fim: str, name: str, cell: int) -> DataFrame:
    """``overlaps_other`` for keys of any size."""
    length = F.col(fim) > F.col(ini)
    rows, forward = df.where(length), df.where(F.col(fim) >= F.col(ini))
    one = F.lit(1).cast("long").alias("_v")
    starts, ends = forward.select(*key, F.col(ini).alias("_t"), one), forward.select(*key, F.col(fim).alias("_t"), one)
    counted = overlaps_any(rows, df.where(F.col(fim) < F.col(ini)), key, ini, fim, "_any", cell)
    started = _lookup(starts, rows.select(*key, F.col(fim).alias("_t")), key, F.sum, cell=cell)
    ended = _lookup(ends, rows.select(*key, F.col(ini).alias("_t")), key, F.sum, True, cell)
    counted = counted.join(started.select(*key, F.col("_t").alias(fim), F.col("_prev").alias("_started")), [*key, fim], "left").join(
        ended.select(*key, F.col("_t").alias(ini), F.col("_prev").alias("_ended")), [*key, ini], "left")
    more = (F.coalesce("_started", F.lit(0)) - F.coalesce("_ended", F.lit(0)) > 1) & _keyed(key)
    flagged = counted.select(*df.columns, (F.col("_any") | more).alias(name))
    return flagged.unionByName(overlaps_any(df.where(~length), df, key, ini, fim, name, cell))


def _with_island(starts: DataFrame, key: list[str], ini: str, fim: str, cell: int) -> DataFrame:
    """Add ``_ilha``, the start of the merged period, to rows that are one for each (key, start)."""
    placed = starts.withColumn("_cell", _cell(ini, cell))
    marked = _running_end(placed, key, ini, fim).withColumn(
        "_open", F.when(F.col("_prev").isNull() | (F.col(ini) > F.col("_prev")), F.col(ini))
    )
    cells = marked.groupBy(*key, "_cell").agg(F.max("_open").alias("_m"))
    carried = _carry(cells, key, "_m", "_carried", F.asc("_cell"), F.max)
    so_far = Window.partitionBy(*key, "_cell").orderBy(ini).rowsBetween(Window.unboundedPreceding, 0)
    return _join_same(marked, carried, [*key, "_cell"]).select(
        *starts.columns, F.coalesce(F.max("_open").over(so_far), F.col("_carried")).alias("_ilha")
    )


def _island_of_start(df: DataFrame, key: list[str], ini: str, fim: str, cell: int) -> DataFrame:
    """(key, start) -> ``_ilha``."""
    starts = df.groupBy(*key, ini).agg(F.max(fim).alias("_end"))
    return _with_island(starts, key, ini, "_end", cell).drop("_end")


def _listed_with_island(light: DataFrame, key: list[str], ini: str, fim: str, columns: list[str]) -> DataFrame:
    """(key, columns, ``_ilha``) of rows of keys that have a few: one walk over the list of a key by start."""
    kind = light.schema[ini].dataType
    none = F.struct(F.lit(None).cast(light.schema[fim].dataType).alias("end"), F.lit(None).cast(kind).alias("ilha"),
                    F.array().cast(ArrayType(kind)).alias("ilhas"))

    def step(so_far, x):
        ilha = F.when(so_far["end"].isNull() | (x[ini] > so_far["end"]), x[ini]).otherwise(so_far["ilha"])
        return F.struct(F.greatest(so_far["end"], x[fim]).alias("end"), ilha.alias("ilha"), F.concat(so_far["ilhas"], F.array(ilha)).alias("ilhas"))

    lists = light.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(ini, fim, *columns))).alias("_all"))
    walked = lists.withColumn("_ilhas", F.aggregate("_all", none, step, lambda done: done["ilhas"]))
    return walked.select(*key, F.explode(F.arrays_zip("_all", "_ilhas")).alias("_x")).select(
        *key, *[F.col("_x._all")[c].alias(c) for c in (ini, fim, *columns)], F.col("_x._ilhas").alias("_ilha"))


def islands(df: DataFrame, key: list[str], ini: str = "inicio", fim: str = "fim", flags: tuple = (),
            per: tuple = (), cell: int = DAY, few: bool = False) -> DataFrame:
    """Merge overlapping or touching intervals of a key into periods.

    Returns ``key, per, ilha, <ini>, <fim>, flags, linhas``: ``ilha`` is the period's first start, a flag is true
    when any merged row has it. With ``per`` columns the periods are found over all rows of the key and then
    reported per value of those columns (each with the start and end of its own rows); without, a period
    is one row. Rows with a missing time or an end before the start do not count.

    Rows of keys with a handful move once, all of a key to one list; ``few`` says that all keys are such, so that nobody counts, and
    nothing moves where rows lie by a part of the key already.
    """
    rows = df.where(F.col(ini).isNotNull() & F.col(fim).isNotNull() & (F.col(fim) >= F.col(ini)))
    light, heavy = (rows, None) if few else light_and_heavy(rows, key, nulls=True)
    one = _listed_with_island(light, key, ini, fim, [*flags, *per]).withColumn("linhas", F.lit(1).cast("long"))
    found = _islands_of(one, key, ini, fim, flags, per)
    return found if heavy is None else found.unionByName(_islands_by_cell(heavy, key, ini, fim, flags, per, cell))


def _islands_by_cell(rows: DataFrame, key: list[str], ini: str, fim: str, flags: tuple, per: tuple, cell: int) -> DataFrame:
    """``islands`` for keys of any size."""
    pieces = rows.groupBy(*key, *per, ini).agg(
        F.max(fim).alias(fim), *[F.max(f).alias(f) for f in flags], F.count("*").alias("linhas")
    )
    # Without further classes a piece is the only one of its start and is labelled as it is.
    labelled = _join_same(pieces, _island_of_start(pieces, key, ini, fim, cell), [*key, ini]) if per else _with_island(pieces, key, ini, fim, cell)
    return _islands_of(labelled, key, ini, fim, flags, per)


def _islands_of(labelled: DataFrame, key: list[str], ini: str, fim: str, flags: tuple, per: tuple) -> DataFrame:
    return (
        labelled
        .groupBy(*key, *per, F.col("_ilha").alias("ilha"))
        .agg(
            F.min(ini).alias(ini), F.max(fim).alias(fim), *[F.max(f).alias(f) for f in flags],
            F.sum("linhas").alias("linhas"),
        )
    )


def temporal_blocks(df: DataFrame, context: list[str], seq: str, ini: str = "inicio", fim: str = "fim",
                    cell: int = DAY) -> DataFrame:
    """Label rows with their block of overlapping or touching intervals within the same context.

    Adds ``bloco`` (first start), ``lider`` (lowest event of the block), ``inicio_bloco``, ``fim_bloco``,
    ``eventos_bloco`` and ``status_bloco`` (``LIDER`` or ``DUPLICADA``).
    """
    rows = df.where(F.col(ini).isNotNull() & F.col(fim).isNotNull() & (F.col(fim) >= F.col(ini)))
    labelled = _join_same(rows, _island_of_start(rows, context, ini, fim, cell), [*context, ini]).withColumnRenamed("_ilha", "bloco")
    blocks = labelled.groupBy(*context, "bloco").agg(
        F.min(seq).alias("lider"), F.min(ini).alias("inicio_bloco"), F.max(fim).alias("fim_bloco"),
        F.countDistinct(seq).alias("eventos_bloco"),
    )
    return _join_same(labelled, blocks, [*context, "bloco"]).withColumn(
        "status_bloco", F.when(F.col(seq) == F.col("lider"), F.lit("LIDER")).otherwise(F.lit("DUPLICADA"))
    )


def _staircases(df: DataFrame, key: list[str], event: str, order: str, ini: str, fim: str, cell: int, once: bool) -> DataFrame:
    """Steps of the two staircases of a key: (key, _t, _step, _second), ``_t`` being the end up to which the step is the first to reach.

    Rows are taken in the order (start, end descending, number, event). A step of the first staircase is a row whose end exceeds all
    earlier ones. For the second the running facts are the latest end so far with its event, and the latest end among the other
    events: a row of another event than the leading one raises the second as far as both ends reach, and is a step of
    the second staircase where that exceeds what the others had. Of equal (key, start, event) only the first row counts, which partial
    aggregation finds; ``once`` leaves the second staircase out, and then one row per (key, start) is enough.
    """
    back = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - F.col(fim)  # the shorter, the later the end
    top = F.min(F.struct(back.alias("d"), F.col(order).alias("o"), F.col(event).alias("e"), F.col(fim).alias("f"))).alias("_t")
    rows = df.groupBy(*key, ini, *([] if once else [event])).agg(top).select(
        *key, F.col(ini).alias("_ri"), F.col("_t.f").alias("_rf"), F.col("_t.o").alias("_ro"), F.col("_t.e").alias("_re"), F.col("_t.d").alias("_rd"),
    ).withColumn("_cell", _cell("_ri", cell))
    earlier = _before([*key, "_cell"], "_ri", "_rd", "_ro", "_re")

    def running(frame: DataFrame, value: str, name: str) -> DataFrame:
        cells = frame.groupBy(*key, "_cell").agg(F.max(value).alias("_m"))
        carried = _carry(cells, key, "_m", "_carried", F.asc("_cell"), F.max)
        return _join_same(frame, carried, [*key, "_cell"]).withColumn(name, F.greatest(F.max(value).over(earlier), F.col("_carried"))).drop("_carried")

    step = F.struct("_ri", "_rf", "_ro", "_re")
    led = running(rows.withColumn("_end", F.struct("_rf", "_re")), "_end", "_lead")
    first = F.col("_lead").isNull() | (F.col("_rf") > F.col("_lead._rf"))
    if once:
        return led.where(first).select(*key, F.col("_rf").alias("_t"), step.alias("_step"), F.lit(None).cast(led.select(step).schema[0].dataType).alias("_second"))
    other = led.withColumn("_both", F.when(F.col("_re") != F.col("_lead._re"), F.least("_rf", "_lead._rf")))
    seconded = running(other, "_both", "_others")
    second = F.col("_both").isNotNull() & (F.col("_others").isNull() | (F.col("_both") > F.col("_others")))
    kinds = F.array_compact(F.array(
        F.when(first, F.struct(F.col("_rf").alias("_t"), F.lit(True).alias("_first"))), F.when(second, F.struct(F.col("_both").alias("_t"), F.lit(False).alias("_first")))))
    placed = seconded.withColumn("_k", F.explode(kinds))
    return placed.select(*key, "_k._t", F.when(F.col("_k._first"), step).alias("_step"), F.when(~F.col("_k._first"), step).alias("_second"))


def best_container(df: DataFrame, key: list[str], event: str, order: str, ini: str = "inicio", fim: str = "fim",
                   cell: int = DAY, once: bool = False) -> DataFrame:
    """Left-join to every row the best interval of another event that contains it.

    A container has another event number, starts no later, ends no earlier, and on an identical interval has
    the lower ``order`` number. The best one starts first, then ends last, then has the lowest number, then the lowest event. Adds
    ``evento_contem, inicio_contem, fim_contem`` (null when nothing contains the row).

    In the order (start, end descending, number, event) a container comes before the row, so the best one is the first row of
    another event whose end reaches the row's. The first row of a key to reach a given end, and the first one of any other event than
    that, are steps of two staircases (see ``_staircases``): a look-up per (key, end) instead of a self-join. The row's container is the
    lowest step of the first staircase that reaches its end, or, where that is the row's own event, of the second, if it comes before
    the row. Nothing is asked of the row itself, so rows that end before they start need no care.
    A row without a full key is contained in nothing. Rows need times, event and order; ``once`` says that an event has one row per key,
    whose first step is then never its own event with another interval.
    """
    light, heavy = light_and_heavy(df, key)
    few = _container_in_list(light, key, event, order, ini, fim)
    return few if heavy is None else few.unionByName(_container_by_steps(heavy, key, event, order, ini, fim, cell, once))


def _container_in_list(df: DataFrame, key: list[str], event: str, order: str, ini: str, fim: str) -> DataFrame:
    """``best_container`` for keys of a few rows, which are compared with each other."""
    back = lambda y: F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - y[fim]

    def holds(x, y):
        ahead = (y[ini] < x[ini]) | ((y[ini] == x[ini]) & ((y[fim] > x[fim]) | (y[order] < x[order])))
        return (y[fim] >= x[fim]) & ahead & (y[event] != x[event])

    def judged(x):
        over = F.transform(F.filter("_all", lambda y: holds(x, y)), lambda y: F.struct(
            y[ini].alias("i"), back(y).alias("b"), y[order].alias("o"), y[event].alias("e"), y[fim].alias("f")))
        return F.struct(x.alias("r"), F.array_min(over).alias("c"))

    columns = [c for c in df.columns if c not in key or c in (event, order, ini, fim)]
    found = listed(df, key, columns).select(*key, F.explode(F.transform("_all", judged)).alias("_x"))
    return found.select(*_out_of_list(df, key, "_x.r"), F.col("_x.c.e").alias("evento_contem"), F.col("_x.c.i").alias("inicio_contem"), F.col("_x.c.f").alias("fim_contem"))


def _container_by_steps(df: DataFrame, key: list[str], event: str, order: str, ini: str, fim: str, cell: int, once: bool) -> DataFrame:
    """``best_container`` for keys of any size."""
    steps = _staircases(df, key, event, order, ini, fim, cell, once)
    stepped = _lowest_steps(df, steps, key, fim, cell)

    def before(step: str) -> Column:
        s, f, o = (F.col(f"{step}.{c}") for c in ("_ri", "_rf", "_ro"))
        return (s < F.col(ini)) | ((s == F.col(ini)) & ((f > F.col(fim)) | (o < F.col(order))))

    other = F.col("_step._re") != F.col(event)
    found = _keyed(key) & other & before("_step")
    beside = F.lit(False) if once else _keyed(key) & ~other & F.col("_second").isNotNull() & before("_second")
    pick = lambda field: F.when(found, F.col(f"_step.{field}")).when(beside, F.col(f"_second.{field}"))
    return stepped.select(*df.columns, pick("_re").alias("evento_contem"), pick("_ri").alias("inicio_contem"), pick("_rf").alias("fim_contem"))


def _lowest_steps(df: DataFrame, steps: DataFrame, key: list[str], fim: str, cell: int) -> DataFrame:
    """Add ``_step`` and ``_second``: of each staircase the lowest step that reaches the row's end."""
    names = ["_step", "_second"]
    asked = df.select(*key, F.col(fim).alias("_t")).withColumns({n: F.lit(None).cast(steps.schema[n].dataType) for n in names})
    ends = asked.unionByName(steps).groupBy(*key, "_t").agg(*[F.max(n).alias(n) for n in names]).withColumn("_cell", _cell("_t", cell))
    cells = ends.groupBy(*key, "_cell").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_t"))).alias(n) for n in names])
    above = _before(key, F.desc("_cell"))
    carried = cells.select(*key, "_cell", *[F.last(n, ignorenulls=True).over(above).alias(f"_above{n}") for n in names])
    from_above = Window.partitionBy(*key, "_cell").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    lowest = ends.join(carried, [*key, "_cell"]).select(
        *key, F.col("_t").alias(fim), *[F.coalesce(F.last(n, ignorenulls=True).over(from_above), F.col(f"_above{n}")).alias(n) for n in names])
    return df.join(lowest, [*key, fim], "left").select(*df.columns, *names)


def contained(df: DataFrame, key: list[str], event: str, order: str, ini: str = "inicio", fim: str = "fim",
              cell: int = DAY, once: bool = False) -> DataFrame:
    """Add ``contido``: another event of the key covers the row (see ``best_container``)."""
    return best_container(df, key, event, order, ini, fim, cell, once).withColumn(
        "contido", F.col("evento_contem").isNotNull()
    ).drop("evento_contem", "inicio_contem", "fim_contem")


def stab_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, ini: str, fim: str,
              cell: int = 3600) -> DataFrame:
    """Inner join of points and intervals of the same key with ``ini <= at <= fim``.

    Equality on (key, cell) spreads a hot key over its cells and lets a hot cell be split at run time. There is a grid for
    each of ``GRIDS`` widths, and an interval is listed in the few cells it touches of the finest one that is not much
    finer than it is long, so no interval meets points far away from it. Key and time columns of the two sides must have
    distinct names except for the key.
    """
    first, last = _cell(ini, cell), _cell(fim, cell)
    width = last - first
    grid = reduce(lambda g, k: g + (width > F.lit(GRID_STEP**k)).cast("int"), range(1, GRIDS), F.lit(0))
    wide = F.pow(F.lit(float(GRID_STEP)), F.col("_grid")).cast("long")
    listed = spans.where(F.col(fim) >= F.col(ini)).withColumn("_grid", grid).withColumn(
        "_gcell", F.explode(F.sequence(F.floor(first / wide), F.floor(last / wide))))
    placed = points.withColumn("_grid", F.explode(F.array(*[F.lit(g) for g in range(GRIDS)]))).withColumn(
        "_gcell", F.floor(_cell(at, cell) / wide))
    return (
        placed
        .join(listed, [*key, "_grid", "_gcell"])
        .where((F.col(ini) <= F.col(at)) & (F.col(at) <= F.col(fim)))
        .drop("_grid", "_gcell")
    )


def trim_partial(df: DataFrame, key: list[str], seq_order: list, ini: str = "inicio", fim: str = "fim",
                 origin: dict | None = None) -> DataFrame:
    """Rows that start inside an earlier interval of the key and end after it, with that predecessor.

    A predecessor starts before the row, ends after the row's start and before the row's end; the best one
    ends last, then starts first, then is first in ``seq_order``. ``origin = {output name: column}`` names what to
    bring from it; ``inicio_origem, fim_origem`` and ``minutos_interseccao`` always come. Only rows that cross at
    least one minute mark are returned.

    Per (key, end) the predecessor can only be the one that starts first, so partial aggregation reduces
    the candidates to one per distinct end. The predecessor of a row is then the last end before its own whose start lies
    before the row, which ``_last_end`` looks up.
    """
    origin = origin or {}
    names = [*origin, "inicio_origem", "fim_origem", "minutos_interseccao"]
    light, heavy = light_and_heavy(df.where(F.col(ini).isNotNull() & F.col(fim).isNotNull() & (F.col(fim) > F.col(ini)) & _keyed(key)), key)
    cut = _trim_in_list(light, key, seq_order, ini, fim, origin)
    cut = cut if heavy is None else cut.unionByName(_trim_by_tree(heavy, key, seq_order, ini, fim, origin))
    crossed = cut.withColumn("minutos_interseccao", minute_boundaries(F.col(ini), F.col("fim_origem")))
    return crossed.where("minutos_interseccao > 0").select(*df.columns, *names)


def _trim_in_list(df: DataFrame, key: list[str], seq_order: list, ini: str, fim: str, origin: dict) -> DataFrame:
    """Rows with their predecessor, for keys of a few rows, which are compared with each other."""
    ranks = {f"_o{i}": o if isinstance(o, Column) else F.col(o) for i, o in enumerate(seq_order)}
    rows = df.withColumns(ranks)
    back = lambda y: F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - y[fim]

    def judged(x):
        ahead = F.filter("_all", lambda y: (y[ini] < x[ini]) & (x[ini] < y[fim]) & (y[fim] < x[fim]))
        best = F.transform(ahead, lambda y: F.struct(
            back(y).alias("b"), y[ini].alias("i"), *[y[o].alias(o) for o in ranks], *[y[c].alias(f"x_{n}") for n, c in origin.items()], y[fim].alias("f")))
        return F.struct(x.alias("r"), F.array_min(best).alias("p"))

    columns = [c for c in rows.columns if c not in key or c in (ini, fim, *origin.values())]
    found = listed(rows, key, columns).select(*key, F.explode(F.transform("_all", judged)).alias("_x")).where("_x.p IS NOT NULL")
    return found.select(*_out_of_list(df, key, "_x.r"), *[F.col("_x.p")[f"x_{n}"].alias(n) for n in origin],
                        F.col("_x.p.i").alias("inicio_origem"), F.col("_x.p.f").alias("fim_origem"))


def _trim_by_tree(df: DataFrame, key: list[str], seq_order: list, ini: str, fim: str, origin: dict) -> DataFrame:
    """Rows with their predecessor, for keys of any size."""
    rows = df.withColumns({"_bu": microsecond_index(ini), "_fu": microsecond_index(fim)})
    best = F.struct(
        F.col("_bu").alias("_s"), *[o.alias(f"_o{i}") if isinstance(o, Column) else F.col(o).alias(f"_o{i}")
                                    for i, o in enumerate(seq_order)],
        *[F.col(c).alias(f"_x_{n}") for n, c in origin.items()], F.col(ini).alias("_pi"), F.col(fim).alias("_pf"),
    )
    ends = rows.groupBy(*key, F.col("_fu").alias("_pu")).agg(F.min(best).alias("_p")).withColumn("_ps", F.col("_p._s"))
    spans = rows.select(*key, "_bu", "_fu").distinct()
    ends = materialize(ends, "fins")  # read for the tree of cells and for the winners' columns
    winners = _last_end(spans, ends, key).join(ends, [*key, "_pu"])
    chosen = winners.select(
        *key, "_bu", "_fu", *[F.col(f"_p._x_{n}").alias(n) for n in origin], F.col("_p._pi").alias("inicio_origem"), F.col("_p._pf").alias("fim_origem"))
    return rows.join(chosen, [*key, "_bu", "_fu"]).select(*df.columns, *origin, "inicio_origem", "fim_origem")


def _grid(ends: DataFrame) -> tuple[int, int, int]:
    """First of the ends ``_pu`` (in microseconds), the unit all of them are whole multiples of after it, and levels a tree over them needs.

    A level divides a cell into ``TREE_STEP``, down to the single unit, so no cell has more children than that.
    """
    low, high, coarse, fine = ends.agg(F.min("_pu"), F.max("_pu"), F.max(F.pmod("_pu", F.lit(1_000_000))), F.max(F.pmod("_pu", F.lit(1000)))).first()
    if low is None:
        return 0, 1, 1
    unit = 1_000_000 if coarse == 0 else 1000 if fine == 0 else 1
    levels = 1
    while TREE_STEP**levels <= (high - low) // unit:
        levels += 1
    return low, unit, levels


def _at_level(us: str, level: int, low: int, unit: int) -> Column:
    """Number of the cell of ``level`` that holds the instant; at level 0 the instant itself, in units."""
    size = unit * TREE_STEP**level
    return F.expr(f"({us} - {low}L - pmod({us} - {low}L, {size}L)) div {size}L")


def _tree(ends: DataFrame, key: list[str], low: int, unit: int, levels: int) -> DataFrame:
    """(key, level, cell) -> ``_kids``: the cells of the level below (at level 0 the ends) in it, each with the earliest start behind it."""
    at = lambda k: _at_level("_pu", k, low, unit)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), at(k + 1).alias("_cell"), at(k).alias("_kid")) for k in range(levels)]))
    placed = ends.select(*key, cells.alias("_c"), "_ps").select(*key, "_c.*", "_ps").groupBy(*key, "_level", "_cell", "_kid").agg(F.min("_ps").alias("_low"))
    # No more than TREE_STEP in a list.
    return placed.groupBy(*key, "_level", "_cell").agg(F.collect_list(F.struct("_kid", "_low")).alias("_kids"))


def _last_end(spans: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, _bu, _fu, _pu): for each span the last end inside it whose start ``_ps`` is before the span, all in microseconds.

    Every span asks the cell of its end at each level of the tree for the last child to the left that has an early enough
    start; the lowest level that answers is nearest. From there one look-up a level leads down to the end itself. A
    span is one row in every join, whatever the number of intervals around it, and meets no more than ``TREE_STEP`` children in each.
    """
    low, unit, levels = _grid(ends)
    tree = materialize(_tree(ends, key, low, unit, levels), "arvore")
    at = lambda ts, k: _at_level(ts, k, low, unit)
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), at("_fu", k + 1).alias("c"), at("_fu", k).alias("below")) for k in range(levels)]))
    least = reduce(lambda w, k: w.when(F.col("_level") == k, at("_bu", k)), range(1, levels), F.when(F.col("_level") == 0, at("_bu", 0) + 1))

    def last_kid(below: Column | None) -> Column:
        fits = lambda x: (x["_low"] < F.col("_bu")) & (x["_kid"] >= F.col("_least")) & (F.lit(True) if below is None else x["_kid"] < below)
        return F.array_max(F.transform(F.filter("_kids", fits), lambda x: x["_kid"]))

    placed = spans.withColumn("_a", asked).select(*spans.columns, F.col("_a.k").alias("_level"), F.col("_a.c").alias("_cell"), F.col("_a.below").alias("_below"))
    up = placed.join(tree, [*key, "_level", "_cell"]).withColumn("_least", least).withColumn("_kid", last_kid(F.col("_below"))).where("_kid IS NOT NULL")
    up = materialize(up.groupBy(*spans.columns).agg(F.min(F.struct("_level", "_kid")).alias("_at")).select(*spans.columns, "_at._level", "_at._kid"), "subida")
    below = up.where(F.col("_level") == levels - 1)
    for k in range(levels - 2, -1, -1):
        down = below.select(*spans.columns, F.lit(k).alias("_level"), F.col("_kid").alias("_cell")).join(tree, [*key, "_level", "_cell"])
        down = down.withColumn("_least", least).withColumn("_kid", last_kid(None)).where("_kid IS NOT NULL")
        below = up.where(F.col("_level") == k).unionByName(down.select(*spans.columns, "_level", "_kid"))
    return below.select(*spans.columns, (F.col("_kid") * F.lit(unit) + F.lit(low)).alias("_pu"))


def overlap_pairs(df: DataFrame, key: list[str], ident: str, columns: list[str], ini: str = "inicio",
                  fim: str = "fim", cell: int = 3600) -> DataFrame:
    """Every unordered pair of a key with ``a.ini < b.fim and b.ini < a.fim``, once.

    Returns the key and ``columns`` (the times and ``ident`` included) as ``a_*`` for the earlier row (ties: lower
    ``ident``, null last, then the other columns) and ``b_*`` for the other. In such a pair the later start lies in the earlier interval, which is
    what the grid join looks for.
    """
    wanted = list(dict.fromkeys([ident, ini, fim, *columns]))
    names = [*key, *[f"{x}_{c}" for x in ("b", "a") for c in wanted]]
    placed = df.where(F.col(ini).isNotNull() & F.col(fim).isNotNull() & _keyed(key)).select(*dict.fromkeys([*key, *wanted]))
    light, heavy = light_and_heavy(placed, key)
    few = _pairs_in_list(light, key, ident, wanted, ini, fim).select(*names)
    return few if heavy is None else few.unionByName(_pairs_by_grid(heavy, key, ident, wanted, ini, fim, cell).select(*names))


def _pairs_in_list(df: DataFrame, key: list[str], ident: str, wanted: list[str], ini: str, fim: str) -> DataFrame:
    """``overlap_pairs`` for keys of a few rows, which are compared with each other."""
    whole = lambda x: F.struct(x[ident].isNull(), x[ident], *[x[c] for c in wanted])

    def meets(a, b):
        first = (a[ini] < b[ini]) | ((a[ini] == b[ini]) & (whole(a) < whole(b)))
        return (b[ini] < a[fim]) & (a[ini] < b[fim]) & first

    pairs = F.flatten(F.transform("_all", lambda a: F.transform(F.filter("_all", lambda b: meets(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = listed(df, key, wanted).select(*key, F.explode(pairs).alias("_x"))
    return found.select(*key, *[F.col(f"_x.{x}")[c].alias(f"{x}_{c}") for x in ("b", "a") for c in wanted])


def _pairs_by_grid(rows: DataFrame, key: list[str], ident: str, wanted: list[str], ini: str, fim: str, cell: int) -> DataFrame:
    """``overlap_pairs`` for keys of any size."""
    left = rows.select(*key, *[F.col(c).alias(f"a_{c}") for c in wanted])
    right = rows.select(*key, *[F.col(c).alias(f"b_{c}") for c in wanted])
    a_ini, a_fim, b_ini, b_fim = (F.col(f"{s}_{c}") for s in ("a", "b") for c in (ini, fim))
    whole = {x: F.struct(F.col(f"{x}_{ident}").isNull(), F.col(f"{x}_{ident}"), *[F.col(f"{x}_{c}") for c in wanted]) for x in ("a", "b")}
    first = (a_ini < b_ini) | ((a_ini == b_ini) & (whole["a"] < whole["b"]))
    return stab_join(right, left, key, f"b_{ini}", f"a_{ini}", f"a_{fim}", cell).where(
        first & (b_ini < a_fim) & (a_ini < b_fim)
    )


def seq_or_last(col) -> Column:
    """Order number for ties, with a missing number last."""
    return F.coalesce(col, F.lit(MAX_SEQ))
