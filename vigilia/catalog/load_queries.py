"""Loading, closing track, consolidation, sinks, streaming and the whole trail."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.time import iso_text
from ..operators.relational import stack
from ..plans import ingest, marts, trail
from ..session import materialize, work_path
from ..sources import files, sinks
from ..sources.versions import VersionedTable
from ..streaming import ingest as live
from . import relations as B
from .quality_queries import FMT, UCCONT, UCROWS, UCTRIM
from .registry import query

KEYS = ", ".join(S.RECORD_KEY)


# ------------------------------------------------------------------------------------ closing track

_CLOSE = f"""cl AS (
  SELECT *, 'x_' || coalesce(REGIONAL_ORIGEM, 'xyz') || '.CSV' AS arquivo_origem, {B._parse('DATA_HORA_INIC_INTRP')} AS i, {B._parse('DATA_HORA_FIM_INTRP')} AS f FROM raw),
clo AS (
  SELECT * EXCLUDE (rn, REGIONAL_ORIGEM), coalesce(REGIONAL_ORIGEM, 'SEM_REGIONAL') AS reg, date_diff('minute', i, f) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY coalesce(NUM_INTRP_UCI, ''), coalesce(NUM_POSTO_UCI, ''), coalesce(NUM_UC_UCI, '')
      ORDER BY arquivo_origem, arquivo_csv, KVA_INTRP, DTHR_INICIO_INTRP_UC, COD_CAUSA_INTRP NULLS LAST, COD_COMP_INTRP NULLS LAST) AS rn FROM cl) WHERE rn = 1),
cla AS (SELECT * FROM clo WHERE i >= TIMESTAMP '2024-02-01' AND f < TIMESTAMP '2024-03-01')"""
_TIES = ["arquivo_csv", "KVA_INTRP", "DTHR_INICIO_INTRP_UC", "COD_CAUSA_INTRP", "COD_COMP_INTRP"]


def closing(t):
    raw = B.raw(t).withColumn("arquivo_origem", F.concat(F.lit("x_"), F.coalesce("REGIONAL_ORIGEM", F.lit("xyz")), F.lit(".CSV")))
    return t.view("closing", lambda: marts.close_month_load(raw, "202402", _TIES))


@query("close_month_load", B.with_(B.RAW, _CLOSE) + f"""
SELECT {KEYS}, reg AS "REGIONAL_ORIGEM", arquivo_origem, m AS duracao_minutos, m < 0 AS erro_duracao, m >= 3 AS duracao_longa FROM clo""")
def close_month_load(t):
    """PIP-18, SRC-09, WIN-03, PRJ-06: closing rows, first file wins, flags null when times cannot be read."""
    return closing(t).select(*S.RECORD_KEY, "REGIONAL_ORIGEM", "arquivo_origem", "duracao_minutos", "erro_duracao", "duracao_longa")


@query("closing_regions", B.with_(B.RAW, _CLOSE) + 'SELECT reg AS "REGIONAL_ORIGEM", count(*) AS linhas FROM clo GROUP BY 1')
def closing_regions(t):
    """AGG-31: rows per region after load."""
    return marts.rows_per_region(closing(t))


@query("close_month_assess", B.with_(B.RAW, _CLOSE) + f"SELECT {KEYS}, strftime(i, {FMT}) AS inicio, strftime(f, {FMT}) AS fim FROM cla")
def close_month_assess(t):
    """PIP-19, FLT-02."""
    return marts.close_month_assess(closing(t), "202402").select(
        *S.RECORD_KEY, iso_text("DATA_HORA_INIC_INTRP_TS").alias("inicio"), iso_text("DATA_HORA_FIM_INTRP_TS").alias("fim"))


_GOOD = f"NOT coalesce(f < i, false) AND NOT {B.BLANK('COD_CAUSA_INTRP')} AND NOT {B.BLANK('COD_COMP_INTRP')}"


@query("close_month_treat", B.with_(B.RAW, _CLOSE) + f"SELECT {KEYS}, COD_CAUSA_INTRP FROM cla WHERE {_GOOD}")
def close_month_treat(t):
    """PIP-20, FLT-10."""
    return marts.close_month_treat(marts.close_month_assess(closing(t), "202402")).select(*S.RECORD_KEY, "COD_CAUSA_INTRP")


@query("closing_counters", B.with_(B.RAW, _CLOSE) + f"""
SELECT count(*) AS total_original, count(*) FILTER (f < i) AS removido_horario_negativo,
       count(*) FILTER (NOT coalesce(f < i, false) AND ({B.BLANK('COD_CAUSA_INTRP')} OR {B.BLANK('COD_COMP_INTRP')})) AS removido_sem_causa_componente,
       count(*) FILTER ({_GOOD}) AS total_final FROM clo""")
def closing_counters(t):
    """AGG-27 (closing): removals per rule."""
    return marts.closing_counters(marts.backfill_timestamps(closing(t)))


_TIMES = ("DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP")


@query("backfill_timestamps", B.with_(B.RAW) + f"""
SELECT {KEYS}, DATA_HORA_INIC_INTRP, DATA_HORA_FIM_INTRP, {B._parse('DATA_HORA_INIC_INTRP')} AS inicio, {B._parse('DATA_HORA_FIM_INTRP')} AS fim, count(*) AS linhas,
       'atualizado' AS status FROM raw GROUP BY ALL""")
def backfill_timestamps(t):
    """PIP-31, SNK-12: a stored month rewritten with typed times, published as the counts agree."""
    path = work_path(t.spark, "backfill")
    B.raw(t).write.parquet(path)
    done = marts.publish_rewrite(t.spark, path, marts.backfill_timestamps)
    rows = t.spark.read.parquet(path).select(
        *S.RECORD_KEY, *_TIMES, F.col("DATA_HORA_INIC_INTRP_TS").alias("inicio"), F.col("DATA_HORA_FIM_INTRP_TS").alias("fim"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("linhas")).withColumn("status", F.lit(done["status"]))


# ----------------------------------------------------------------------------------- consolidation

_STAMP = "CASE WHEN arquivo_csv = 'b.csv' THEN '20240302000000' ELSE '20240301000000' END"


def _dmy(c):
    return f"try_strptime(trim({c}), '%d/%m/%Y %H:%M:%S')"


_EV_TIES = ["NUM_SEQ_INTRP", "KVA_INTRP", "CONS_INTRP", "COD_AREA_ELET_INTRP", "DESC_INTRP"]
_UC_TIES = ["DATA_HORA_FIM_INTRP", "DTHR_INICIO_INTRP_UC", "PID_POSTO_PIN", "COD_AREA_ELET_INTRP", "NUM_MOTIVO_TRAT_DIF_UCI"]


def _ties(cols):
    return ", ".join(f"{c} NULLS LAST" for c in cols)


_CONSOL = f"""snap AS (SELECT *, {_STAMP} AS snapshot_ts, coalesce(REGIONAL_ORIGEM, 'XXX') AS arquivo_origem FROM raw),
ce AS (SELECT * EXCLUDE rn FROM (SELECT *, CASE WHEN nullif(trim(PID), '') IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY PID ORDER BY snapshot_ts DESC NULLS LAST,
    arquivo_csv DESC NULLS LAST, {_ties(_EV_TIES)}) END AS rn FROM snap) WHERE rn = 1),
cu AS (SELECT * EXCLUDE rn FROM (SELECT *, CASE WHEN NUM_POSTO_UCI IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {KEYS} ORDER BY snapshot_ts DESC NULLS LAST,
    arquivo_csv DESC NULLS LAST, {_ties(_UC_TIES)}) END AS rn FROM snap) WHERE rn = 1)"""


def snapshots(t):
    return B.raw(t).withColumns({
        "snapshot_ts": F.when(F.col("arquivo_csv") == "b.csv", F.lit("20240302000000")).otherwise(F.lit("20240301000000")),
        "arquivo_origem": F.coalesce("REGIONAL_ORIGEM", F.lit("XXX")),
    })


@query("consolidate_events", B.with_(B.RAW, _CONSOL) + f"""
SELECT nullif(trim(PID), '') AS pid, NUM_SEQ_INTRP AS seq, round(c * s / 3600.0, 4) AS chi, round(s / 3600.0, 6) AS duracao_horas, arquivo_csv FROM (
  SELECT *, date_diff('second', {_dmy('DATA_HORA_INIC_INTRP')}, {_dmy('DATA_HORA_FIM_INTRP')}) AS s,
         try_cast(replace(replace(CONS_INTRP, '.', ''), ',', '.') AS DOUBLE) AS c FROM ce)
WHERE s >= 0 AND c >= 0 AND strftime({_dmy('DATA_HORA_INIC_INTRP')}, '%Y%m') = '202402'""")
def consolidate_events(t):
    """PIP-27, WIN-07, FLT-12, PRJ-24, SRC-13: newest snapshot per event, valid events of the month."""
    return ingest.consolidate(snapshots(t), 2024, 2, _EV_TIES, _UC_TIES)["eventos"].select(
        F.col("PID").alias("pid"), F.col("NUM_SEQ_INTRP").alias("seq"), F.round("CHI", 4).alias("chi"), F.round("duracao_horas", 6).alias("duracao_horas"), "arquivo_csv")


@query("consolidate_ucs", B.with_(B.RAW, _CONSOL) + f"""
SELECT {KEYS}, arquivo_csv, strftime({_dmy('DTHR_INICIO_INTRP_UC')}, {FMT}) AS inicio FROM cu
WHERE {_dmy('DATA_HORA_FIM_INTRP')} >= {_dmy('DTHR_INICIO_INTRP_UC')} AND strftime({_dmy('DTHR_INICIO_INTRP_UC')}, '%Y%m') = '202402'""")
def consolidate_ucs(t):
    """PIP-27: newest snapshot per record key, rows without a key kept."""
    return ingest.consolidate(snapshots(t), 2024, 2, _EV_TIES, _UC_TIES)["ucs"].select(*S.RECORD_KEY, "arquivo_csv", iso_text("DTHR_INICIO_INTRP_UC").alias("inicio"))


@query("manifest", B.with_(B.RAW, _CONSOL) + """
SELECT DISTINCT 2024 AS ano, 2 AS mes, arquivo_origem AS regional, arquivo_csv, substr(snapshot_ts, 1, 4) || '-' || substr(snapshot_ts, 5, 2) || '-' || substr(snapshot_ts, 7, 2) || ' 00:00:00' AS timestamp_arquivo FROM snap""")
def manifest(t):
    """SNK-09: one row per source file."""
    return sinks.manifest(snapshots(t), 2024, 2, B.RUN_TS).drop("atualizado_em")


# ------------------------------------------------------------------------------------ logs of files

_FILES = """log AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'g/' ELSE 'f/' END || user_id || '/' || event_type || '.csv' AS p, CASE WHEN event_id % 7 = 0 THEN 'erro' WHEN event_id % 11 = 0 THEN '' ELSE 'processado' END AS s,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS m, event_id % 3 AS size FROM events),
fl AS (SELECT DISTINCT 'f/' || user_id || '/' || event_type || '.csv' AS p, event_type, user_id FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY m DESC, s) AS rn FROM log) WHERE rn = 1)"""


def _file_tables(t):
    path = F.concat(F.lit("f/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".csv"))
    found = t.events.select(path.alias("arquivo_path"), path.alias("arquivo_nome"), F.concat(F.lit("20240"), (F.col("user_id") % 9 + 1).cast("string")).alias("anomes")).distinct()
    status = F.when(F.col("event_id") % 7 == 0, F.lit("erro")).when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.lit("processado"))
    # Files of one kind are logged under another folder, so none of their entries is found.
    logged = F.when(F.col("event_type") == "signup", F.regexp_replace(path, "^f", "g")).otherwise(path)
    log = t.events.select(
        logged.alias("arquivo_path"), logged.alias("arquivo_nome"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processado_em"),
        (F.col("event_id") % 3).alias("arquivo_tamanho_bytes"), F.lit(None).cast("timestamp").alias("arquivo_modificado_em"), F.lit(None).cast("long").alias("linhas_lidas"))
    return found, log


@query("file_status_counts", B.with_(_FILES) + """
SELECT '20240' || (user_id % 9 + 1) AS anomes, count(*) AS arquivos_encontrados, count(*) FILTER (s = 'processado') AS arquivos_processados,
       count(*) FILTER (coalesce(nullif(s, ''), 'pendente') <> 'processado') AS arquivos_pendentes, count(*) FILTER (s = 'erro') AS arquivos_com_erro
FROM fl LEFT JOIN last ON last.p = fl.p GROUP BY 1""")
def file_status_counts(t):
    """SRC-03: latest status per file and counts per month."""
    return files.status_counts(files.file_status(*_file_tables(t)))


@query("pending_files", B.with_(_FILES) + "SELECT p AS arquivo_path FROM fl WHERE p NOT IN (SELECT p FROM log WHERE s = 'processado')")
def pending_files(t):
    """SRC-02: files not processed yet."""
    found, log = _file_tables(t)
    return files.pending(found, log, ["arquivo_path"]).select("arquivo_path")


@query("log_tail", B.with_(_FILES) + """
SELECT p AS arquivo_path, s AS status, m AS processado_em FROM log ORDER BY m DESC, size, p, s LIMIT 25""")
def log_tail(t):
    """SRT-08: the newest log rows, ties by the other columns."""
    return files.log_tail(_file_tables(t)[1].drop("arquivo_nome", "arquivo_modificado_em", "linhas_lidas").withColumnRenamed("arquivo_tamanho_bytes", "a"), 25).select(
        "arquivo_path", "status", "processado_em")


@query("compact_log", B.with_(_FILES) + "SELECT p AS arquivo_path, size AS arquivo_tamanho_bytes, s AS status, max(m) AS processado_em FROM log GROUP BY 1, 2, 3")
def compact_log(t):
    """SNK-10: newest log row per file state and status."""
    return files.compact_log(_file_tables(t)[1].withColumn("arquivo_modificado_em", F.lit("2024-01-01").cast("timestamp"))).select(
        "arquivo_path", "arquivo_tamanho_bytes", "status", "processado_em")


# --------------------------------------------------------------------------------- tables and files


@query("append_new_rows", """
WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m') AS anomes FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m') AS anomes, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3)
SELECT s.* FROM s LEFT JOIN e ON e.l_orderkey = s.l_orderkey AND e.l_linenumber = s.l_linenumber AND e.anomes = s.anomes WHERE e.l_orderkey IS NULL""")
def append_new_rows(t):
    """PIP-01, WIN-01: new rows by key and month against the keys already there."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.date_format("l_shipdate", "yyyyMM").alias("anomes"))
    return ingest.new_rows(rows.where("l_returnflag <> 'A'").drop("l_returnflag"), rows.where("l_returnflag = 'A'"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("month_overwrite", """
SELECT strftime(o_orderdate, '%Y%m') AS anomes, count(*) AS linhas, round(sum(CASE WHEN year(o_orderdate) = 1997 THEN 0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1""")
def month_overwrite(t):
    """SNK-01, STR-03: only the months of the second write are replaced."""
    path = work_path(t.spark, "month-overwrite")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyyMM").alias("anomes"), F.year("o_orderdate").alias("y"))
    sinks.write_month(rows, path)
    sinks.write_month(rows.where("y = 1997").withColumn("o_totalprice", F.lit(0.0)), path)
    back = t.spark.read.parquet(path).groupBy(F.col("anomes").cast("string").alias("anomes"))
    return back.agg(F.count("*").alias("linhas"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("current_month", "SELECT count(*) AS linhas, strftime(max(o_orderdate), '%Y%m') AS anomes FROM orders WHERE strftime(o_orderdate, '%Y%m') = (SELECT strftime(max(o_orderdate), '%Y%m') FROM orders)")
def current_month(t):
    """SNK-02: the newest month as a view."""
    rows = t.orders.withColumn("anomes", F.date_format("o_orderdate", "yyyyMM"))
    return sinks.current_month(rows).groupBy("anomes").agg(F.count("*").alias("linhas"))


@query("csv_roundtrip", B.with_(B.RAW) + """
SELECT coalesce(REGIONAL_ORIGEM, 'SEM_REGIONAL') AS regional, count(*) AS linhas, count(nullif(trim(NUM_OPER_CHV_INTRP), '')) AS com_equipamento,
       count(DISTINCT NUM_UC_UCI) AS ucs, count(KVA_INTRP) AS com_kva FROM raw GROUP BY 1""")
def csv_roundtrip(t):
    """PIP-12, SNK-03/04, SRC-04/05/07: regional delimited files written, classified and read back."""
    path = work_path(t.spark, "csv-export")
    sinks.export_regional(B.raw(t), path, compression="gzip")
    listed = t.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv.gz").load(path).select("path")
    rows = files.read_outage_files(t.spark, [r.path for r in listed.toLocalIterator()])
    region = F.regexp_extract("arquivo_path", "regional_part=([^/]+)/", 1)
    return files.good_rows(rows).groupBy(region.alias("regional")).agg(
        F.count("*").alias("linhas"), F.count(F.nullif(F.trim("NUM_OPER_CHV_INTRP"), F.lit(""))).alias("com_equipamento"),
        F.countDistinct("NUM_UC_UCI").alias("ucs"), F.count("KVA_INTRP").alias("com_kva"))


def _write_lines(lines, header: str, path: str, encoding: str = "UTF-8") -> None:
    """Files of the given lines (one text column) after a header line, as they are."""
    lines.select(F.col(lines.columns[0]).alias(header)).write.options(header=True, sep="\x01", encoding=encoding, emptyValue="").csv(path)


def _piped(*columns):
    return F.concat_ws(S.CSV_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns])


@query("mixed_files", """
SELECT CASE WHEN o_orderkey % 50 = 7 THEN 'rejeitada' ELSE 'boa' END AS tipo, CAST(o_orderkey AS VARCHAR) AS num_intrp,
       CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderpriority || ' – ação' END AS texto, CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderstatus END AS posto FROM orders""")
def mixed_files(t):
    """SRC-04..07: two headers, two encodings, bad lines and a file without header; every row comes out under its own columns."""
    folder = work_path(t.spark, "mixed")
    rows = t.orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("p"), F.lit("1").alias("u"), F.month("o_orderdate").alias("m"),
        F.concat("o_orderpriority", F.lit(" – ação")).alias("d"), F.when(F.col("o_orderkey") % 50 == 7, F.lit("|sobra")).otherwise(F.lit("")).alias("x"))
    _write_lines(rows.where("m % 2 = 1").select(F.concat(_piped("k", "p", "u", "d"), "x")), "NUM_INTRP_UCI|NUM_POSTO_UCI|NUM_UC_UCI|DESC_INTRP", f"{folder}/a")
    # Code page 1252 is Latin-1 but for a few bytes: the dash is one of them.
    other = rows.where("m % 2 = 0").withColumn("d", F.translate("d", "–", "\x96")).select(F.concat(_piped("d", "u", "k", "p"), "x"))
    _write_lines(other, "DESC_INTRP|NUM_UC_UCI|NUM_INTRP_UCI|NUM_POSTO_UCI", f"{folder}/b", "ISO-8859-1")
    _write_lines(rows.select(_piped("k", "p")), "sem|nome", f"{folder}/c")
    listed = t.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv").load(folder).select("path")
    read = materialize(files.read_outage_files(t.spark, [r.path for r in listed.toLocalIterator()]), "lidas")  # parsed once for rows and bad lines
    good = files.good_rows(read).select(F.lit("boa").alias("tipo"), F.col("NUM_INTRP_UCI").alias("num_intrp"), F.col("DESC_INTRP").alias("texto"), F.col("NUM_POSTO_UCI").alias("posto"))
    bad = files.bad_rows(read).select(F.split("linha", r"\|").alias("f"), F.col("arquivo_path").contains("/a/").alias("a"))
    number = F.when(F.col("a"), F.col("f")[0]).otherwise(F.col("f")[2])
    return good.unionByName(bad.select(F.lit("rejeitada").alias("tipo"), number.alias("num_intrp"), F.lit(None).cast("string").alias("texto"), F.lit(None).cast("string").alias("posto")))


@query("closing_files", """
SELECT CAST(o_orderkey AS VARCHAR) AS numero, o_orderstatus AS estado, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' é' END AS texto FROM orders""")
def closing_files(t):
    """SRC-09: closing files of two headers in one folder, each read by its own, bad lines failing the read."""
    folder = work_path(t.spark, "closing")
    rows = t.orders.select(
        F.col("o_orderkey").alias("numero"), F.col("o_orderstatus").alias("estado"), F.concat("o_orderpriority", F.lit(" é")).alias("texto"))
    for part in (rows.where("numero % 2 = 0"), rows.where("numero % 2 = 1").select("estado", "numero")):
        part.write.mode("append").options(header=True, sep=S.CSV_SEPARATOR).csv(folder)
    return files.read_closing(t.spark, folder).select("numero", "estado", "texto")


@query("snapshot_kept", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def snapshot_kept(t):
    """SNK-08: the state before a change is kept once; a later snapshot leaves it as it is."""
    path, rows = work_path(t.spark, "before"), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for state in ("F", "O"):
        sinks.snapshot_once(rows.where(F.col("o_orderstatus") == state), path)
    return t.spark.read.parquet(path)


@query("reset_of_a_month", """
SELECT CAST(o_orderkey AS VARCHAR) AS arquivo_path, strftime(o_orderdate, '%Y%m') AS anomes FROM orders
WHERE strftime(o_orderdate, '%Y%m') = '199503' OR o_orderkey % 3 = 0""")
def reset_of_a_month(t):
    """SNK-11, SRC-02: after its month leaves the log, a file is pending again, as are those that were never processed."""
    found = t.orders.select(F.col("o_orderkey").cast("string").alias("arquivo_path"), F.lit(1).cast("long").alias("arquivo_tamanho_bytes"),
                            F.col("o_orderdate").alias("arquivo_modificado_em"), F.date_format("o_orderdate", "yyyyMM").alias("anomes"), F.col("o_orderkey").alias("_k"))
    log = found.withColumn("status", F.when(F.col("_k") % 3 == 0, F.lit("erro")).otherwise(F.lit("processado")))
    return files.pending(found, files.without_month(log, "199503")).select("arquivo_path", "anomes")


@query("stream_load", B.with_(B.RAW) + f"""
SELECT DISTINCT "ANOMES_PROCESSAMENTO" AS anomes, {", ".join(f"nullif({c}, ' ') AS {c}" for c in S.RECORD_KEY)} FROM raw""")
def stream_load(t):
    """STR-01..03: files of two headers and encodings arrive, a stream appends rows with a new key by month, a second run adds nothing."""
    spark = t.spark
    folder, table, mark = (work_path(spark, f"stream-{n}") for n in ("in", "table", "checkpoint"))
    names = [*S.RECORD_KEY, "DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP", "ANOMES_PROCESSAMENTO"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = materialize(B.raw(t).select(*names), "brutas")  # made once for both kinds of files
    half = F.pmod(F.xxhash64(*names), F.lit(2)) == 0
    _write_lines(rows.where(half).select(_piped(*names)), "|".join(names), f"{folder}/a")
    _write_lines(rows.where(~half).select(F.concat(_piped(*names[::-1]), F.lit("|ação"))), "|".join([*names[::-1], "DESC_INTRP"]), f"{folder}/b", "ISO-8859-1")
    for _ in range(2):
        q = live.load_arriving(spark, folder, table, mark, schema=schema, max_files=4, month=F.col("ANOMES_PROCESSAMENTO"))
        q.awaitTermination()
    return spark.read.parquet(table).select(F.col("anomes").cast("string").alias("anomes"), *S.RECORD_KEY)


# -------------------------------------------------------------------------------------- whole trail


def _on(part: str, table: str = "apu") -> str:
    return re.sub(r"\buni\b", table, part)


_APU = f"""apu AS (
  SELECT * FROM uni WHERE {B.INI} >= TIMESTAMP '2024-02-01' AND {B.INI} < TIMESTAMP '2024-03-01' AND {B.FIM} >= TIMESTAMP '2024-02-01'
    AND {B.FIM} < TIMESTAMP '2024-03-01' AND (ESTADO_INTRP IS NULL OR ESTADO_INTRP <> '7'))"""
_FLAGS = _on(B.FLAGS)
_TRAIL = B.with_(B.RAW, B.UNI, _APU, _on(B.NEG), _on(B.DEV), B.DEVPAIRS, _on(B.UCBASE), B.UCBEST, _on(B.DEVCONT), _FLAGS, _on(B.BASE), B.BILLED,
                 B.NETUC, B.OFFICIAL, B.LEVELS)


@query("run_trail", _TRAIL + f"""
SELECT 'uniao' AS etapa, count(*) AS linhas FROM uni UNION ALL SELECT 'apuracao', count(*) FROM apu
UNION ALL SELECT 'pendencias', (SELECT count(*) FROM neg) + (SELECT count(*) FROM devpairs) + (SELECT count(*) FROM ucbest)
  + (SELECT count(DISTINCT NUM_SEQ_INTRP) FROM apu WHERE {B.BLANK('COD_CAUSA_INTRP')} OR {B.BLANK('COD_COMP_INTRP')})
UNION ALL SELECT 'sobreposicao_interrupcao', count(*) FROM devcont UNION ALL SELECT 'tratamento', count(*) FROM tratado
UNION ALL SELECT 'indicadores', count(DISTINCT (nivel, regional_origem, cod_conjunto_aneel)) FROM levels UNION ALL SELECT 'ressarcimento', count(*) FROM netuc""")
def run_trail(t):
    """PIP-32: all default steps of a month as one application; rows of each stage."""
    root = work_path(t.spark, "trail")
    done = trail.run_trail(t.spark, B.raw(t), root, "202402", B.RUN_TS, tiebreak=B.TIEBREAK, targets=B.targets(t), vrc=B.vrcs(t), billed=B.billed(t), billed_counts=B.official(t))
    return stack(*[df.agg(F.count("*").alias("linhas")).select(F.lit(step).alias("etapa"), "linhas") for step, df in done.items()])


@query("publish_half_way", B.with_(B.RAW, B.UNI, _APU) + f"""
SELECT {", ".join(S.RECORD_KEY)}, SIGLA_REGIONAL, strftime({B.INI}, {FMT}) AS inicio, strftime({B.FIM}, {FMT}) AS fim, duracao FROM apu""")
def publish_half_way(t):
    """SNK-01, SNK-12: a month published whole; a rewrite that loses rows dies before its commit and is not seen."""
    month = marts.assess_month(B.uni(t), "202402", B.RUN_TS, drop_cancelled=True)
    table = VersionedTable(t.spark, work_path(t.spark, "published"))
    table.publish(month.limit(0))
    table.publish(month)
    table.prepare(table.read().where("duracao > 60"))
    return table.read().select(*S.RECORD_KEY, "SIGLA_REGIONAL", iso_text(B.INI).alias("inicio"), iso_text(B.FIM).alias("fim"), "duracao")


_APU91 = """apu91 AS (
  SELECT * REPLACE (CASE WHEN NUM_INTRP_UCI || '|' || NUM_POSTO_UCI || '|' || NUM_UC_UCI IN (SELECT chave_registro FROM uccont WHERE chave_registro IS NOT NULL)
                         THEN '91' ELSE NUM_MOTIVO_TRAT_DIF_UCI END AS NUM_MOTIVO_TRAT_DIF_UCI) FROM apu)"""
_OVERLAPS = B.with_(B.RAW, B.UNI, _APU, _on(UCROWS), UCCONT, _APU91, _on(UCROWS, "apu91").replace("ucrows", "ucrows2"),
                    UCTRIM.replace("ucrows", "ucrows2"))


@query("run_trail_overlaps", _OVERLAPS + f"""
SELECT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI, NUM_MOTIVO_TRAT_DIF_UCI AS motivo, coalesce(c.seq_origem, NUM_INTRP_INIC_MANOBRA_UCI) AS manobra,
       strftime(coalesce(date_trunc('second', c.fim_origem), {B.INI_UC}), {FMT}) AS inicio_uc
FROM apu91 LEFT JOIN uctrim c ON c.chave_registro = NUM_INTRP_UCI || '|' || NUM_POSTO_UCI || '|' || NUM_UC_UCI""")
def run_trail_overlaps(t):
    """PIP-32 with both UC-overlap steps: the assessed month after classification and trimming, each deployed to it."""
    work = trail.Trail(t.spark, work_path(t.spark, "trail-overlaps"), "202402", B.RUN_TS)
    work.run(B.raw(t), B.targets(t), tiebreak=B.TIEBREAK, steps=["uniao", "apuracao", "sobreposicao_uc", "sobreposicao_uc_fase2"])
    return work.read("apuracao").select(
        *S.RECORD_KEY, F.col("NUM_MOTIVO_TRAT_DIF_UCI").alias("motivo"), F.col("NUM_INTRP_INIC_MANOBRA_UCI").alias("manobra"), iso_text(B.INI_UC).alias("inicio_uc"))
