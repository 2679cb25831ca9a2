"""Relational building blocks (DataFrame in, DataFrame out)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..session import materialize


def _order(columns) -> list[Column]:
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in columns]


def resolve(df: DataFrame, wanted: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Select ``{name: accepted columns}``; first accepted column present wins, case does not matter.

    A name without any match becomes a null text column, unless it is ``required``.
    """
    present = {c.upper(): c for c in df.columns}
    out, missing = [], []
    for name, candidates in wanted.items():
        found = next((present[c.upper()] for c in candidates if c.upper() in present), None)
        if found is None and name in required:
            missing.append(f"{name} (one of {', '.join(candidates)})")
        out.append((F.col(found) if found else F.lit(None).cast("string")).alias(name))
    if missing:
        raise ValueError("missing columns: " + "; ".join(missing))
    return df.select(*out)


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    present = {c.upper(): c for c in df.columns}
    return next((present[c.upper()] for c in candidates if c.upper() in present), None)


def first_available(sources: dict[str, DataFrame | None]) -> tuple[str | None, DataFrame | None]:
    """The first source that exists, with its name, to be carried along as a literal column."""
    return next(((name, df) for name, df in sources.items() if df is not None), (None, None))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail with the list of missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def backfill(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns that are absent as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, first in ``order``.

    ``row_number = 1`` plans as a group limit on both sides of the exchange: each task forwards at most one
    row per key, so a key that holds a third of the rows costs the receiving task no more than any other.
    """
    rank = Window.partitionBy(*key).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")


def dedup_by_key(df: DataFrame, key: list[str], order: list, tiebreak: list | None = None) -> DataFrame:
    """``first_per_key`` with a total order: ``tiebreak`` columns, else a hash of all remaining ones.

    A hash keeps the sort key short; listing fifty columns there makes the comparison too large to compile.
    """
    if tiebreak is not None:
        return first_per_key(df, key, [*order, *tiebreak])
    named = {c for c in order if isinstance(c, str)}
    rest = sorted(set(df.columns) - set(key) - named)
    hashed = df.withColumn("_h", F.xxhash64(*rest) if rest else F.lit(0))
    return first_per_key(hashed, key, [*order, "_h"]).drop("_h")


def stored_rows(df: DataFrame) -> bool:
    """Whether rows of ``df`` can be told by file and position: a scan of Parquet files, filtered or projected at most."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


# Rows of a file whose places are the bits of one value: as many as ``bitmap_construct_agg`` takes.
BLOCK = 32768


def _block_of(place: str) -> list[Column]:
    """File, block and bit of a place (file, position)."""
    at = F.col(f"{place}.linha")
    return [F.col(f"{place}.arquivo").alias("_arquivo"), F.floor(at / BLOCK).alias("_bloco"), F.pmod(at, F.lit(BLOCK)).alias("_bit")]


def _bits_of(places: DataFrame) -> DataFrame:
    """(``_arquivo``, ``_bloco``, ``_bits``) of places, one bit for each. They are dealt out by block before they are put together, so
    that a block is one value, not one for each task."""
    return places.repartition("_arquivo", "_bloco").groupBy("_arquivo", "_bloco").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _words_of(bits: DataFrame) -> DataFrame:
    """``_bits`` of blocks as ``_palavras``, 64 bits each: one of them is read without a copy of the block."""
    word = "conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10)"
    words = F.expr(f"transform(sequence(0, {BLOCK // 64 - 1}), i -> CAST({word} AS BIGINT))")
    return bits.select("_arquivo", "_bloco", words.alias("_palavras"))


def _at_places(located: DataFrame, words: DataFrame, there: bool) -> DataFrame:
    """Rows of ``located`` whose place has its bit set in ``words`` (or has not), which are broadcast.

    It is a filter, so it goes down to the scan: columns that are worked out of stored ones are worked out for the rows that stay,
    and no block becomes part of a row.
    """
    own = {"_arquivo": "_seu_arquivo", "_bloco": "_seu_bloco", "_bit": "_seu_bit"}  # names of their own: the same ones would be taken for those of the words
    bit = F.col(own["_bit"]).outer()
    word = F.get("_palavras", F.shiftright(bit, 6).cast("int"))
    at = F.lit(56) - F.shiftright(bit, 3).bitwiseAND(F.lit(7)) * 8 + bit.bitwiseAND(F.lit(7))  # bytes of a word from the left, bits of a byte from the right
    block = (F.col("_arquivo") == F.col(own["_arquivo"]).outer()) & (F.col("_bloco") == F.col(own["_bloco"]).outer())
    found = F.broadcast(words).where(block & (F.getbit(word, at.cast("int")) == 1)).exists()
    return located.select("*", *_block_of("_lugar")).withColumnsRenamed(own).where(found if there else ~found).select(*located.columns)


def _alone(located: DataFrame, key: list[str]) -> DataFrame:
    """Places of rows whose key no other row has, told by a hash of the key: four numbers a row move, whatever the key is made of.

    Keys that share a hash are taken for repeated ones, of which the rows are then compared.
    """
    hashed = located.select(F.xxhash64(*key).alias("_k"), "_lugar.arquivo", "_lugar.linha")
    once = hashed.groupBy("_k").agg(F.count("*").alias("_n"), F.min("arquivo").alias("arquivo"), F.min("linha").alias("linha")).where("_n = 1")
    return once.select(F.struct("arquivo", "linha").alias("_lugar")).select(*_block_of("_lugar"))


def dedup_stored(table: DataFrame, key: list[str], order: list[str], tiebreak: list[str] | None = None) -> DataFrame:
    """``dedup_by_key`` for a table in storage (see ``stored_rows``): narrow rows are ranked once, and the table is read without those that repeat.

    Rows whose key no other row has stay, which a hash of the key tells; only the others move with key and order. The first
    row of each repeated key is a minimum over (order, tiebreak, file, position), which partial aggregation finds. The places of
    all rows that stay are stored as one bit for each row of a file and broadcast: a row of the table looks up its own bit, so
    no row of the table is exchanged or sorted, whatever the share of repeated ones and however wide, and columns nobody asks for are not read.
    A key that holds any part of the rows is one row in either aggregation. Files are told by the 64-bit hash of their path.
    """
    located = table.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("arquivo"), F.col("_metadata.row_index").alias("linha")).alias("_lugar"))
    alone = materialize(_bits_of(_alone(located, key)), "unicas")
    if tiebreak is None:
        rest = sorted(set(table.columns) - set(key) - set(order))
        located, tiebreak = located.withColumn("_h", F.xxhash64(*rest) if rest else F.lit(0)), ["_h"]
    last = lambda c: F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))  # noqa: E731  (nulls last)
    ranked = F.struct(*[last(c).alias(f"o{i}") for i, c in enumerate([*order, *tiebreak])], F.col("_lugar").alias("lugar"))
    best = _at_places(located, _words_of(alone), False).groupBy(*key).agg(F.min(ranked).alias("_best")).select(F.col("_best.lugar").alias("_lugar"))
    first = _bits_of(best.select(*_block_of("_lugar")))
    kept = alone.unionByName(first).groupBy("_arquivo", "_bloco").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    kept = materialize(_words_of(kept), "primeiras")
    return _at_places(located, kept, True).select(*table.columns)


def dedup_keep_incomplete(df: DataFrame, key: list[str], order: list, tiebreak: list | None = None, together: bool = False) -> DataFrame:
    """Dedup rows with a full key; rows where a key part is blank all stay and take no part in the exchange.

    ``together`` is for rows that lie by a part of the key already: each row with a blank part is then ranked alone, and nothing moves.
    """
    complete = F.lit(True)
    for c in key:
        complete = complete & blank_to_null(c).isNotNull()
    if tiebreak is None:
        named = {c for c in order if isinstance(c, str)}
        rest = sorted(set(df.columns) - set(key) - named)
        df, tiebreak = df.withColumn("_h", F.xxhash64(*rest) if rest else F.lit(0)), ["_h"]
    if together:
        apart = df.withColumn("_alone", F.when(~complete, F.monotonically_increasing_id()))
        return first_per_key(apart, [*key, "_alone"], [*order, *tiebreak]).drop("_alone", "_h")
    kept = first_per_key(df.where(complete), key, [*order, *tiebreak])
    return kept.unionByName(df.where(~complete)).drop("_h")


def top_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each group, with their position."""
    rank = Window.partitionBy(*group).orderBy(*_order(order))
    return df.withColumn("posicao", F.row_number().over(rank)).where(F.col("posicao") <= n)


def update_from(df: DataFrame, changes: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """Replace ``df[column]`` by ``changes[new]`` where a change exists (``columns = {column: new}``).

    ``changes`` holds one row per key. Keys join by equality, so a row with a null key part stays as it is.
    """
    side = changes.select(*key, *[F.col(new).alias(f"_new_{c}") for c, new in columns.items()])
    out = df.join(side, key, "left")
    values = {
        c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in df.columns else F.col(f"_new_{c}") for c in columns
    }
    names = df.columns + [c for c in columns if c not in df.columns]
    return out.withColumns(values).select(*names)


def with_latest(df: DataFrame, log: DataFrame, key: list[str], order: list, values: dict[str, object]) -> DataFrame:
    """Left join the latest log row per key; ``values = {column: default}`` names what to bring along."""
    latest = first_per_key(log, key, order).select(*key, *values)
    out = df.drop(*[c for c in values if c in df.columns]).join(latest, key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in values.items() if d is not None}
    return out.withColumns(filled) if filled else out


def paged(df: DataFrame, order: list, limit: int, offset: int = 0, where: Column | None = None,
          max_limit: int = 5000) -> DataFrame:
    """One page of a listing. A page of more than ``max_limit`` rows, of none, or before the first is an error."""
    if not 1 <= limit <= max_limit or offset < 0:
        raise ValueError(f"a page has 1 to {max_limit} rows and begins at 0 or later, not {limit} rows from {offset}")
    rows = df if where is None else df.where(where)
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: dict | None = None, max_limit: int = 5000) -> DataFrame:
    """The page of a listing that follows ``cursor``, the sort key of the last row seen (none: the first page).

    ``order`` names columns, true for ascending, nulls last in either case; together they must tell rows apart, or rows equal to the cursor
    are left out. The cursor is a filter: its first column reaches the scan, and no page pays for those before it.
    """
    if not 1 <= limit <= max_limit:
        raise ValueError(f"a page has 1 to {max_limit} rows, not {limit}")
    by = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]
    if cursor is None:
        return df.orderBy(*by).limit(limit)
    here = lambda c: F.lit(cursor[c]).cast(df.schema[c].dataType)
    past = lambda c, up: F.lit(False) if cursor[c] is None else (F.col(c) > here(c) if up else F.col(c) < here(c)) | F.col(c).isNull()
    after, equal = F.lit(False), F.lit(True)
    for c, up in order:
        after, equal = after | (equal & past(c, up)), equal & F.col(c).eqNullSafe(here(c))
    first, up = order[0]
    bound = F.col(first).isNull() if cursor[first] is None else (F.col(first) >= here(first) if up else F.col(first) <= here(first)) | F.col(first).isNull()
    return df.where(bound & after).orderBy(*by).limit(limit)


def last_of(page: DataFrame, order: list[tuple[str, bool]]) -> dict | None:
    """The cursor after a page (no more rows than a page has), or none after an empty one."""
    rows = page.select(*[c for c, _ in order]).collect()
    return rows[-1].asDict() if rows else None


def mode_per_group(df: DataFrame, group: list[str], value: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per group (ties: smallest), counted before anything is ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    best = first_per_key(counts, group, [F.desc("_n"), F.asc(value)])
    return best.select(*group, F.col(value).alias(name or value), F.col("_n").alias("ocorrencias"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    bins: int = 4096) -> DataFrame:
    """Interpolated exact quantiles per group, without holding a group in one task.

    Values are counted first (partial counts before the exchange). Every quantile needs the values at two
    ranks; each pass cuts the value range that holds a rank into ``bins`` equal parts, counts the parts,
    and keeps the part the rank falls in, until that part is a single value: a few passes, as each divides the
    range by ``bins``.
    """
    counts = materialize(
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n")),
        "valores",
    )
    totals = counts.groupBy(*group).agg(
        F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    ranks = F.array(*[
        F.struct(F.lit(name).alias("p"), F.lit(side).alias("side"), F.lit(float(q)).alias("q"))
        for name, q in probs.items() for side in (0, 1)
    ])
    position = F.col("_r.q") * (F.col("_total") - 1)
    targets = (
        totals.withColumn("_r", F.explode(ranks))
        .select(
            *group, "_total", "_lo", "_hi", F.col("_r.p").alias("_p"), F.col("_r.side").alias("_side"),
            position.alias("_pos"),
            F.when(F.col("_r.side") == 0, F.floor(position)).otherwise(F.ceil(position)).cast("long").alias("_rank"),
            F.lit(0).cast("long").alias("_below"),
        )
    )
    ident = [*group, "_p", "_side"]
    while True:
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
        # Ends of the range are parts of their own, so that every pass leaves a smaller range.
        part = F.when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(F.col("_v") == F.col("_hi"), F.lit(bins)).otherwise(
            F.greatest(F.lit(0), F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)))).cast("long")
        inside = targets.join(counts, group).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        parts = inside.withColumn("_part", part).groupBy(*ident, "_part").agg(
            F.sum("_n").alias("_in"), F.min("_v").alias("_plo"), F.max("_v").alias("_phi"),
            F.first("_pos").alias("_pos"), F.first("_rank").alias("_rank"), F.first("_below").alias("_below"),
        )
        w = Window.partitionBy(*ident).orderBy("_part")
        parts = parts.withColumn("_upto", F.sum("_in").over(w) + F.col("_below"))
        hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_in"))
        targets = materialize(parts.where(hit).select(
            *ident, "_pos", "_rank", F.col("_plo").alias("_lo"), F.col("_phi").alias("_hi"),
            (F.col("_upto") - F.col("_in")).alias("_below"),
        ), "quantis")
        if targets.where("_lo < _hi").isEmpty():
            break
    at_rank = targets.withColumn("_v", F.col("_lo"))
    pair = at_rank.groupBy(*group, "_p").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"),
        F.max("_pos").alias("_pos"),
    )
    quantile = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return pair.groupBy(*group).agg(*[
        F.max(F.when(F.col("_p") == name, quantile)).alias(name) for name in probs
    ])
