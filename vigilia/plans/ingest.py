"""Loading outage files into the month table, and consolidating month snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import blank_to_null, num_br
from ..functions.time import DMY, parse_ts, second_index
from ..operators.relational import backfill, dedup_by_key, dedup_keep_incomplete, require, stack
from ..session import materialize
from ..sources import files as src
from ..sources.sinks import append_log, append_rows


def _null_safe(left: DataFrame, right: DataFrame, columns: list[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


# Staged rows up to which the keys of a table are told apart before they move, and words of 64 bits in which that is done.
FEW_ROWS, WORDS = 2**23, 2**20


def _perhaps_staged(known: DataFrame, staged: DataFrame, key: list[str], rows: int) -> DataFrame:
    """``known`` without most of the keys that are not among the ``rows`` of ``staged``; none that is among them is missing.

    Each staged key sets four bits in one of at most ``WORDS`` words, which are broadcast: a key of the table is looked up as it is
    read, and only those whose bits are set move. With eight keys to a word, the most there are, some three in a hundred others come along.
    """
    words = WORDS
    while words > 1024 and words // 2 * 4 >= rows:
        words //= 2
    here = F.xxhash64(*key)
    bits = [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(_h, {at}) & 63 AS INT))") for at in (24, 30, 36, 42)]
    marks = reduce(lambda a, b: a.bitwiseOR(b), bits)
    placed = lambda df: df.withColumn("_h", here).withColumns({"_word": F.col("_h").bitwiseAND(F.lit(words - 1)), "_marks": marks})
    found = placed(staged.select(*key)).groupBy(F.col("_word").alias("_w")).agg(F.bit_or("_marks").alias("_set"))
    met = (F.col("_word") == F.col("_w")) & (F.col("_set").bitwiseAND(F.col("_marks")) == F.col("_marks"))
    return placed(known).join(F.broadcast(found), met, "left_semi").select(*key)


def new_rows(staged: DataFrame, existing: DataFrame | None, key: list[str] | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """Staged rows whose record key the month does not hold yet, one per key.

    The month's own rows win, so they are neither read in full nor rewritten: only their keys take part, and of those only the ones
    that may be staged are exchanged (see ``_perhaps_staged``), together with the staged rows, which move once.
    """
    key = ["anomes", *(key or S.RECORD_KEY)]
    require(staged, key)
    if existing is None:
        return dedup_by_key(staged, key, [], tiebreak)
    # The months at hand are a few values; as literals they prune the table's partitions at planning time.
    months = {r[0]: r[1] for r in staged.groupBy("anomes").agg(F.count("*")).toLocalIterator()}
    here = F.col("anomes").cast("string").isin([m for m in months if m is not None])
    known = existing.where(here | F.col("anomes").isNull() if None in months else here)
    known = known.withColumn("anomes", F.col("anomes").cast("string")).select(*key)
    if any(known.schema[c].dataType != staged.schema[c].dataType for c in key):
        one = dedup_by_key(staged, key, [], tiebreak)
        return one.join(known, _null_safe(one, known, key), "left_anti")
    if sum(months.values()) <= FEW_ROWS:
        known = _perhaps_staged(known, staged, key, sum(months.values()))
    both = stack(staged.withColumn("_new", F.lit(1)), known.withColumn("_new", F.lit(0)))
    return dedup_by_key(both, key, ["_new"], tiebreak).where("_new = 1").drop("_new").select(*staged.columns)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.option("mergeSchema", True).parquet(path) if fs.exists(location) else None


def ingest(spark: SparkSession, folder: str, table: str, log_path: str, run_ts: str, min_anomes: str = "") -> DataFrame:
    """Load the files of ``folder`` not loaded yet into ``table`` (partitioned by month) and log them.

    Lines that do not fit go to ``<table>_rejeitadas``, once for each state of a file; a file with such lines, or without
    a header, is logged as ``erro`` and tried again by the next run. Its good lines load and the other files are
    unaffected. Returns the log rows written. Rows are appended before they are logged, and appending skips known
    keys and files whose rejects are known, so a run that dies can be repeated.
    """
    found = src.discover(spark, folder, min_anomes=min_anomes)
    log = table_or_none(spark, log_path)
    todo = (found if log is None else src.pending(found, log)).select(*src.FILE_KEY, "arquivo_nome", "anomes")
    paths = [r.arquivo_path for r in todo.select("arquivo_path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], S.CSV_LOG_SCHEMA)
    # The text is read once, and parsed once for rows, bad lines and counts.
    lines = src.stage_lines(spark, paths)
    kinds = materialize(src.classify(lines), "cabecalhos")
    rows = materialize(src.with_file_columns(src.parse_lines(spark, lines, kinds)), "staged")
    good = src.good_rows(rows).drop("snapshot_ts")
    append_rows(new_rows(good.drop("arquivo_path"), table_or_none(spark, table)).drop("arquivo_nome"), table)

    plain = lambda c: F.regexp_replace(c, "^file:/+", "/").alias("_p")
    todo = todo.withColumn("_p", plain("arquivo_path"))
    bad = src.bad_rows(rows).select(plain("arquivo_path"), "linha").join(todo.select("_p", *src.FILE_KEY), "_p").drop("_p")
    known = table_or_none(spark, table + "_rejeitadas")
    if known is not None:
        bad = bad.join(known.select(*src.FILE_KEY).distinct(), src.FILE_KEY, "left_anti")
    append_log(bad.withColumn("processado_em", F.lit(run_ts)), table + "_rejeitadas")

    counts = rows.groupBy(plain("arquivo_path")).agg(F.count("*").alias("linhas_lidas"), F.count(src.BAD).alias("_bad"))
    nameless = src.headerless(kinds).select(plain("arquivo_path"), F.lit(True).alias("_nameless"))
    entries = todo.join(counts, "_p", "left").join(nameless, "_p", "left").select(
        "arquivo_path", "arquivo_nome", "arquivo_tamanho_bytes", "arquivo_modificado_em", "anomes",
        F.lit(run_ts).alias("processado_em"),
        F.when((F.col("_bad") > 0) | F.col("_nameless"), F.lit("erro")).otherwise(F.lit("processado")).alias("status"),
        F.coalesce("linhas_lidas", F.lit(0)).cast("long").alias("linhas_lidas"),
        F.when(F.col("_nameless"), F.lit("sem cabecalho")).when(
            F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" linhas rejeitadas"))).alias("mensagem_erro"),
    )
    append_log(entries, log_path)
    return src.read_log_rows(spark, log_path, run_ts)


def consolidate(raw: DataFrame, year: int, month: int, event_ties: list | None = None, uc_ties: list | None = None) -> dict[str, DataFrame]:
    """Event table and UC table of a month from all its snapshots.

    ``raw`` carries ``arquivo_origem`` (region), ``snapshot_ts`` and ``arquivo_csv``. Newest snapshot per event
    (``PID``) and per record key; rows without a key all stay; rows with unreadable or reversed times, or outside
    the month, leave; events also need a consumer count.
    """
    tags = ["arquivo_origem", "snapshot_ts", "arquivo_csv"]
    newest = [F.desc_nulls_last("snapshot_ts"), F.desc_nulls_last("arquivo_csv")]
    event_columns = [c for c in S.EVENT_COLUMNS if c in raw.columns]
    uc_columns = [c for c in S.UC_COLUMNS if c in raw.columns]
    if "TIPO_PROTOC_JUSTIF_INTRP" in raw.columns:
        uc_columns.append("TIPO_PROTOC_JUSTIF_INTRP")

    def in_month(ts):
        return (F.year(ts) == year) & (F.month(ts) == month)

    events = raw.select(*event_columns, *tags)
    if "PID" in event_columns:
        events = dedup_keep_incomplete(events, ["PID"], newest, event_ties)
    events = events.withColumns({
        "DATA_HORA_INIC_INTRP": parse_ts("DATA_HORA_INIC_INTRP", (DMY,), native=False),
        "DATA_HORA_FIM_INTRP": parse_ts("DATA_HORA_FIM_INTRP", (DMY,), native=False),
        "CONS_INTRP": num_br("CONS_INTRP", thousands=True),
        "NUM_OCORRENCIA_ADMS": blank_to_null("NUM_OCORRENCIA_ADMS"), "PID": blank_to_null("PID"),
    })
    hours = (second_index("DATA_HORA_FIM_INTRP") - second_index("DATA_HORA_INIC_INTRP")) / F.lit(3600.0)
    events = events.withColumn("duracao_horas", hours).withColumn("CHI", F.col("CONS_INTRP") * F.col("duracao_horas")).where(
        (F.col("DATA_HORA_FIM_INTRP") >= F.col("DATA_HORA_INIC_INTRP")) & (F.col("CONS_INTRP") >= 0) & in_month("DATA_HORA_INIC_INTRP")
    )
    ucs = dedup_keep_incomplete(raw.select(*uc_columns, *tags), S.RECORD_KEY, newest, uc_ties)
    ucs = backfill(ucs, {"COD_AREA_ELET_INTRP": "string"}).withColumns({
        "NUM_UC_UCI": F.trim("NUM_UC_UCI"),
        "DTHR_INICIO_INTRP_UC": parse_ts("DTHR_INICIO_INTRP_UC", (DMY,), native=False),
        "DATA_HORA_FIM_INTRP": parse_ts("DATA_HORA_FIM_INTRP", (DMY,), native=False),
    }).where(
        blank_to_null("NUM_UC_UCI").isNotNull() & (F.col("DATA_HORA_FIM_INTRP") >= F.col("DTHR_INICIO_INTRP_UC"))
        & in_month("DTHR_INICIO_INTRP_UC")
    )
    return {"eventos": events, "ucs": ucs}
