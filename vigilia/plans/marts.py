"""Month tables: union of all months, monthly assessment, governance, closing track, timestamp backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import blank_to_null, int_or, is_blank, record_key, record_key_slots, region, region_from_file
from ..functions.time import (
    DMY, DMY_MINUTE, ISO, ISO_MINUTE, elapsed_minutes, minute_boundaries, month_bounds, parse_ts,
)
from ..operators.intervals import contained
from ..operators.relational import (
    backfill, dedup_by_key, dedup_stored, find_column, first_per_key, require, stack, stored_rows, with_latest,
)
from ..session import materialize

TIMES = {
    "DATA_HORA_INIC_INTRP": "DATA_HORA_INIC_INTRP_TS",
    "DATA_HORA_FIM_INTRP": "DATA_HORA_FIM_INTRP_TS",
    "DTHR_INICIO_INTRP_UC": "DTHR_INICIO_INTRP_UC_TS",
}


def merge_month(staged: DataFrame, existing: DataFrame | None = None, key: list[str] | None = None,
                tiebreak: list[str] | None = None) -> DataFrame:
    """Month table from newly read rows and the rows already there; a row already there wins."""
    key = key or S.RECORD_KEY
    rows = staged.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = stack(existing.withColumn("_new", F.lit(0)), rows)
    require(rows, key)
    return dedup_by_key(rows, key, ["_new"], tiebreak).drop("_new")


def build_union(months: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """One row per record key over all months, with typed times, duration, flags and region.

    ``months`` carries ``ANOMES_PROCESSAMENTO``. Rows of a key are ordered by start and end text.
    """
    require(months, [*S.RECORD_KEY, "DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP"])
    months = backfill(months, {"SIGLA_REGIONAL": "string", "REGIONAL_ORIGEM": "string",
                               "DTHR_INICIO_INTRP_UC": "string"})
    dedup = dedup_stored if stored_rows(months) else dedup_by_key
    one = dedup(months, S.RECORD_KEY, ["DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP"], tiebreak)
    typed = one.withColumns({ts: parse_ts(raw) for raw, ts in TIMES.items()})
    minutes = elapsed_minutes("DATA_HORA_INIC_INTRP_TS", "DATA_HORA_FIM_INTRP_TS")
    return typed.withColumn("duracao", minutes).withColumns({
        "REGIONAL_ORIGEM": region("SIGLA_REGIONAL", "REGIONAL_ORIGEM"),
        "erro_duracao": F.coalesce(F.col("duracao") < 0, F.lit(False)),
        "duracao_longa": F.coalesce(F.col("duracao") >= 3, F.lit(False)),
    })


def assess_month(union: DataFrame, anomes: str, run_ts: str, drop_rejected: bool = False,
                 drop_cancelled: bool = False) -> DataFrame:
    """Rows whose start and end both fall in the month.

    Filters on the typed columns when the table has them, which lets row groups be skipped at the scan. The
    rejection filter applies only where the table carries a validation status.
    """
    first, after = month_bounds(anomes)
    ini = F.col("DATA_HORA_INIC_INTRP_TS") if "DATA_HORA_INIC_INTRP_TS" in union.columns else parse_ts("DATA_HORA_INIC_INTRP")
    fim = F.col("DATA_HORA_FIM_INTRP_TS") if "DATA_HORA_FIM_INTRP_TS" in union.columns else parse_ts("DATA_HORA_FIM_INTRP")
    rows = union.where((ini >= first) & (ini < after) & (fim >= first) & (fim < after))
    if drop_rejected and "status_validacao" in union.columns:
        status = F.lower(F.col("status_validacao").cast("string"))
        rows = rows.where(status.isNull() | (status != "rejeitado"))
    if drop_cancelled:
        state = F.trim(F.col("ESTADO_INTRP").cast("string"))
        rows = rows.where(state.isNull() | (state != S.STATE_CANCELLED))
    return rows.withColumns({
        "MES_APURACAO": F.lit(str(anomes).strip()),
        "DATA_HORA_ETL_APURACAO": F.lit(run_ts),
    })


GOVERNANCE = {
    "validado": False, "status_validacao": "pendente", "motivo_status": None, "usuario_validacao": None,
    "data_hora_validacao": None,
}


def change_log(log: DataFrame) -> DataFrame:
    """Any accepted form of the change log as record key, the five governance columns and their time."""
    def pick(*names, cast="string", default=None):
        found = find_column(log, list(names))
        return (F.col(found).cast("string").try_cast(cast) if found else F.lit(default).cast(cast))

    parts = F.split(F.col("chave_registro").cast("string"), r"\|")
    moment = pick("data_hora", "data_hora_alteracao", "criado_em", cast="timestamp_ntz")
    return log.where(F.col("chave_registro").isNotNull()).select(
        *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(S.RECORD_KEY)],
        F.coalesce(pick("validado", cast="boolean"), F.lit(False)).alias("validado"),
        F.coalesce(pick("status_validacao", "status", default="pendente"), F.lit("pendente")).alias("status_validacao"),
        pick("motivo_status", "justificativa").alias("motivo_status"),
        pick("usuario").alias("usuario_validacao"),
        moment.alias("data_hora_validacao"),
    )


def apply_governance(rows: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Add the latest decision per record key; rows without one are pending."""
    if log is None or "chave_registro" not in log.columns:
        kinds = {"validado": "boolean", "data_hora_validacao": "timestamp_ntz"}
        return rows.withColumns({c: F.lit(d).cast(kinds.get(c, "string")) for c, d in GOVERNANCE.items()})
    order = [F.desc_nulls_last("data_hora_validacao"), F.asc_nulls_last("status_validacao"),
             F.asc_nulls_last("motivo_status"), F.asc_nulls_last("usuario_validacao")]
    return with_latest(rows, change_log(log), S.RECORD_KEY, order, GOVERNANCE)


def backfill_timestamps(rows: DataFrame) -> DataFrame:
    """Add the typed time columns a month table lacks."""
    return rows.withColumns({
        ts: parse_ts(raw) for raw, ts in TIMES.items() if ts not in rows.columns and raw in rows.columns
    })


def same_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Guard for an in-place rewrite: one row with both counts and whether they agree."""
    counts = before.agg(F.count("*").alias("antes"), F.lit(None).cast("long").alias("depois")).unionByName(
        after.agg(F.lit(None).cast("long").alias("antes"), F.count("*").alias("depois"))
    )
    return counts.agg(F.max("antes").alias("antes"), F.max("depois").alias("depois")).withColumn(
        "igual", F.col("antes") == F.col("depois")
    )


def publish_rewrite(spark: SparkSession, path: str, change) -> dict:
    """Rewrite the table at ``path`` as ``change`` of it, if no row is lost or gained.

    The new state is written beside the table and its rows are counted; only then is the old one moved away (to
    ``<path>.anterior``, the copy kept of the last rewrite) and the new one put in its place. Returns the two counts, whether they
    agree and ``status``: ``atualizado`` or ``erro``, in which case the table is as it was.
    """
    beside, before_path = f"{path}.novo", f"{path}.anterior"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(beside)
    counts = same_row_count(spark.read.parquet(path), spark.read.parquet(beside)).first().asDict()
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not counts["igual"]:
        fs.delete(place(beside), True)
        return counts | {"status": "erro"}
    fs.delete(place(before_path), True)
    if not (fs.rename(place(path), place(before_path)) and fs.rename(place(beside), place(path))):
        raise OSError(f"{path}: the new state is at {beside}, the old one at {path} or {before_path}")
    spark.catalog.refreshByPath(path)
    return counts | {"status": "atualizado"}


# ------------------------------------------------------------------------------------ closing track

CLOSING_FORMATS = (DMY, ISO, DMY_MINUTE, ISO_MINUTE)


def close_month_load(raw: DataFrame, anomes: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Closing table from raw closing rows with their file name in ``arquivo_origem``.

    The first file name wins per record key (a missing key part counts as a value of its own). Without any
    key column all rows stay. The flags stay null when a time cannot be read.
    """
    derived = ["ANOMES_PROCESSAMENTO", "REGIONAL_ORIGEM", "duracao_minutos", "erro_duracao", "duracao_longa"]
    rows = raw.drop(*[c for c in derived if c in raw.columns])
    if {"DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP"} <= set(rows.columns):
        minutes = minute_boundaries(parse_ts("DATA_HORA_INIC_INTRP", CLOSING_FORMATS, native=False),
                                    parse_ts("DATA_HORA_FIM_INTRP", CLOSING_FORMATS, native=False))
        flags = {"duracao_minutos": minutes, "erro_duracao": minutes < 0, "duracao_longa": minutes >= 3}
    else:
        flags = {"duracao_minutos": F.lit(None).cast("long"), "erro_duracao": F.lit(False),
                 "duracao_longa": F.lit(False)}
    key = [c for c in S.RECORD_KEY if c in rows.columns]
    if key:
        slots = [f"_k_{c}" for c in key]
        rows = rows.withColumns({s: F.coalesce(c, F.lit("")) for s, c in zip(slots, map(F.col, key))})
        dedup = dedup_stored if stored_rows(rows) else dedup_by_key
        rows = dedup(rows, slots, ["arquivo_origem"], tiebreak).drop(*slots)
    return rows.withColumns({
        "ANOMES_PROCESSAMENTO": F.lit(anomes),
        "REGIONAL_ORIGEM": region_from_file("arquivo_origem"),
        **flags,
    })


def rows_per_region(rows: DataFrame) -> DataFrame:
    return rows.groupBy("REGIONAL_ORIGEM").agg(F.count("*").alias("linhas"))


def close_month_assess(closing: DataFrame, anomes: str) -> DataFrame:
    """Closing rows that start no earlier than the month and end before the next one."""
    first, after = month_bounds(anomes)
    rows = backfill_timestamps(closing)
    return rows.where((F.col("DATA_HORA_INIC_INTRP_TS") >= first) & (F.col("DATA_HORA_FIM_INTRP_TS") < after))


def closing_flags(rows: DataFrame) -> dict:
    negative = F.coalesce(F.col("DATA_HORA_FIM_INTRP_TS") < F.col("DATA_HORA_INIC_INTRP_TS"), F.lit(False))
    codes = is_blank("COD_CAUSA_INTRP") | is_blank("COD_COMP_INTRP")
    return {"negativo": negative, "sem_codigo": codes}


def close_month_treat(assessed: DataFrame) -> DataFrame:
    """Drop negative durations and missing codes; a missing time keeps the row."""
    f = closing_flags(assessed)
    return assessed.where(~f["negativo"] & ~f["sem_codigo"])


def closing_counters(assessed: DataFrame) -> DataFrame:
    f = closing_flags(assessed)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return assessed.agg(
        F.count("*").alias("total_original"), count(f["negativo"]).alias("removido_horario_negativo"),
        count(~f["negativo"] & f["sem_codigo"]).alias("removido_sem_causa_componente"),
        count(~f["negativo"] & ~f["sem_codigo"]).alias("total_final"),
    )


# ------------------------------------------------------------------------------ history, one query


def from_history(history: DataFrame) -> DataFrame:
    """Rows of the historic integration table in the working layout, all text except times."""
    times = ("DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP", "DTHR_INICIO_INTRP_UC")
    mapped = []
    for name, source in S.HISTORY_LAYOUT.items():
        column = F.lit(None) if source is None else F.col(source)
        mapped.append((column if name in times else column.cast("string")).alias(name))
    code = F.upper(F.trim(F.col("SIGLA_REGIONAL_INTRP_PRIM_HIADMS")))
    place = F.when(code.isin(S.REGIONS), code).otherwise(region_from_file(F.upper(F.col(S.HISTORY_FILE))))
    return history.select(*mapped, place.alias("REGIONAL_ORIGEM"), F.col(S.HISTORY_LOADED_AT), F.col(S.HISTORY_FILE))


def treated_from_history(history: DataFrame, anomes: str) -> DataFrame:
    """Treated rows of a month straight from the historic table.

    Month window, layout mapping, newest load per key, no negative duration, both codes present, and no event
    that another event of the same device contains.
    """
    first, after = month_bounds(anomes)
    start, end = S.HISTORY_LAYOUT["DATA_HORA_INIC_INTRP"], S.HISTORY_LAYOUT["DATA_HORA_FIM_INTRP"]
    inside = history.where(
        (F.col(start) >= first) & (F.col(start) < after) & (F.col(end) >= first) & (F.col(end) < after)
    )
    rows = from_history(inside).withColumn("_key", record_key_slots())
    order = [F.desc_nulls_last(S.HISTORY_LOADED_AT), F.desc_nulls_last(S.HISTORY_FILE)]
    rows = first_per_key(rows, ["_key"], order).drop("_key", S.HISTORY_LOADED_AT, S.HISTORY_FILE)
    ini, fim = F.col("DATA_HORA_INIC_INTRP"), F.col("DATA_HORA_FIM_INTRP")
    clean = rows.where(ini.isNull() | fim.isNull() | (fim >= ini)).where(
        blank_to_null("COD_CAUSA_INTRP").isNotNull() & blank_to_null("COD_COMP_INTRP").isNotNull()
    )
    events = clean.where(
        (F.col("ESTADO_INTRP") == S.STATE_ELIGIBLE) & (F.col("TIPO_EQP_INTRP") == "C")
        & blank_to_null("NUM_OPER_CHV_INTRP").isNotNull() & F.col("NUM_SEQ_INTRP").isNotNull()
        & ini.isNotNull() & fim.isNotNull()
    ).select("NUM_OPER_CHV_INTRP", "NUM_SEQ_INTRP", ini.alias("inicio"), fim.alias("fim")).distinct()
    # A few narrow rows per event, read several times below: stored once instead of deduplicating again each time.
    events = materialize(events.withColumn("_o", int_or(F.regexp_replace("NUM_SEQ_INTRP", "[^0-9]", ""), 0)), "eventos")
    excluded = contained(events, ["NUM_OPER_CHV_INTRP"], "NUM_SEQ_INTRP", "_o").where("contido").select(
        "NUM_SEQ_INTRP"
    ).distinct()
    seconds = F.col("duracao_minutos")
    return (
        clean.join(excluded, "NUM_SEQ_INTRP", "left_anti")
        .withColumn("duracao_minutos", elapsed_minutes("DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP"))
        .withColumn("duracao_minutos", F.round(seconds, 6))
        .withColumn("ANOMES_PROCESSAMENTO", F.lit(anomes))
    )


def registro(df: DataFrame) -> DataFrame:
    """Add the display form of the record key."""
    return df.withColumn("chave_registro", record_key())
