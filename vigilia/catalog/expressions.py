"""Column expressions and row-level operators."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.time import elapsed_minutes, iso_text, minute_boundaries, parse_ts
from ..operators import relational as R
from ..plans import deploy, marts
from ..sources import sinks
from . import relations as B
from .registry import query

KEY = ", ".join(S.RECORD_KEY)


@query("timestamp_parse", B.with_(B.RAW) + f"""
SELECT NUM_INTRP_UCI, NUM_UC_UCI, arquivo_csv, strftime({B._parse('DATA_HORA_INIC_INTRP')}, '%Y-%m-%d %H:%M:%S') AS inicio,
       strftime({B._parse('DATA_HORA_FIM_INTRP')}, '%Y-%m-%d %H:%M:%S') AS fim,
       strftime({B._parse('DTHR_INICIO_INTRP_UC')}, '%Y-%m-%d %H:%M:%S') AS inicio_uc FROM raw""")
def timestamp_parse(t):
    """PRJ-01: several text formats to timestamps, bad text to null."""
    return B.raw(t).select(
        "NUM_INTRP_UCI", "NUM_UC_UCI", "arquivo_csv", iso_text(parse_ts("DATA_HORA_INIC_INTRP")).alias("inicio"),
        iso_text(parse_ts("DATA_HORA_FIM_INTRP")).alias("fim"), iso_text(parse_ts("DTHR_INICIO_INTRP_UC")).alias("inicio_uc"),
    )


@query("minute_boundaries", B.with_(B.EV) + """
SELECT seq, date_diff('minute', inicio, fim) AS marcos, round(date_diff('second', inicio, fim) / 60.0, 6) AS minutos,
       date_diff('minute', inicio, fim) >= 3 AS longa FROM ev""")
def minute_boundaries_query(t):
    """PRJ-03/PRJ-23: minute marks crossed against elapsed minutes."""
    marks = minute_boundaries("inicio", "fim")
    return B.ev(t).select("seq", marks.alias("marcos"), F.round(elapsed_minutes("inicio", "fim"), 6).alias("minutos"), (marks >= 3).alias("longa"))


@query("decimal_comma_numbers", B.with_(B.RAW) + """
SELECT COD_AREA_ELET_INTRP AS area, count(*) AS linhas, round(sum(try_cast(replace(KVA_INTRP, ',', '.') AS DOUBLE)), 4) AS kva,
       round(sum(try_cast(replace(replace(CONS_INTRP, '.', ''), ',', '.') AS DOUBLE)), 4) AS consumidores,
       coalesce(try_cast(COD_AREA_ELET_INTRP AS DOUBLE) <= 6, false) AS area_i
FROM raw GROUP BY 1, 5""")
def decimal_comma_numbers(t):
    """PRJ-10, PRJ-19: numbers with decimal comma and thousands dots; area-one flag."""
    return B.raw(t).groupBy(F.col("COD_AREA_ELET_INTRP").alias("area"), X.area_one("COD_AREA_ELET_INTRP").alias("area_i")).agg(
        F.count("*").alias("linhas"), F.round(F.sum(X.num_br("KVA_INTRP")), 4).alias("kva"),
        F.round(F.sum(X.num_br("CONS_INTRP", thousands=True)), 4).alias("consumidores"),
    )


@query("region_map", B.with_(B.RAW) + f"""
SELECT {B.region_sql('SIGLA_REGIONAL', 'REGIONAL_ORIGEM')} AS regional, SIGLA_REGIONAL AS sigla, count(*) AS linhas,
       count(DISTINCT NUM_UC_UCI) AS ucs FROM raw GROUP BY 1, 2""")
def region_map(t):
    """PRJ-05: region from letter or code, company label when unknown."""
    return B.raw(t).groupBy(X.region("SIGLA_REGIONAL", "REGIONAL_ORIGEM").alias("regional"), F.col("SIGLA_REGIONAL").alias("sigla")).agg(
        F.count("*").alias("linhas"), F.countDistinct("NUM_UC_UCI").alias("ucs")
    )


@query("record_keys", B.with_(B.RAW) + """
SELECT count(*) AS linhas, count(NUM_INTRP_UCI || '|' || NUM_POSTO_UCI || '|' || NUM_UC_UCI) AS completas,
       count(DISTINCT NUM_INTRP_UCI || '|' || NUM_POSTO_UCI || '|' || NUM_UC_UCI) AS distintas,
       count(DISTINCT coalesce(NUM_INTRP_UCI, '') || '|' || coalesce(NUM_POSTO_UCI, '') || '|' || coalesce(NUM_UC_UCI, '')) AS com_vazios
FROM raw""")
def record_keys(t):
    """PRJ-07/PRJ-08: composite keys, null when a part is null or with empty slots."""
    return B.raw(t).select(X.record_key().alias("k"), X.record_key_slots().alias("s")).agg(
        F.count("*").alias("linhas"), F.count("k").alias("completas"), F.countDistinct("k").alias("distintas"),
        F.countDistinct("s").alias("com_vazios"),
    )


@query("protocol_classes", B.with_(B.RAW) + """
SELECT CASE WHEN coalesce(trim(TIPO_PROTOC_JUSTIF_UCI), '') NOT IN ('', '0') OR coalesce(trim(TIPO_PROTOC_JUSTIF_INTRP), '') NOT IN ('', '0')
            THEN 'Expurgo' ELSE 'Liquido' END AS classe,
       CASE WHEN trim(NUM_MOTIVO_TRAT_DIF_UCI) IS NOT NULL AND trim(NUM_MOTIVO_TRAT_DIF_UCI) NOT IN ('', '0') THEN 'Ignorar'
            WHEN trim(TIPO_PROTOC_JUSTIF_UCI) = '0' THEN 'Liquido' ELSE 'Expurgo' END AS classe_tripla, count(*) AS linhas
FROM raw GROUP BY 1, 2""")
def protocol_classes(t):
    """PRJ-18: net or excluded by protocol, two-way and three-way."""
    return B.raw(t).groupBy(
        X.net_class("TIPO_PROTOC_JUSTIF_UCI", "TIPO_PROTOC_JUSTIF_INTRP").alias("classe"),
        X.three_way_class("NUM_MOTIVO_TRAT_DIF_UCI", "TIPO_PROTOC_JUSTIF_UCI").alias("classe_tripla"),
    ).agg(F.count("*").alias("linhas"))


@query("voltage_multiplier", """
WITH r AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'A' WHEN p_size % 3 = 1 THEN 'B' ELSE 'C' END AS grupo,
       CASE p_size % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3a' WHEN 3 THEN '4' ELSE 'S' END AS nivel FROM part)
SELECT grupo, nivel, CASE WHEN grupo = 'A' AND nivel IN ('1','2','3') THEN 108 WHEN grupo = 'A' AND nivel IN ('3a','3A','4','S') THEN 40
            WHEN grupo = 'B' THEN 34 ELSE 0 END AS kei, count(*) AS ucs
FROM r GROUP BY 1, 2, 3""")
def voltage_multiplier(t):
    """PRJ-20: multiplier by voltage group and level."""
    s = F.col("p_size")
    rows = t.part.select(
        F.when(s % 3 == 0, F.lit("A")).when(s % 3 == 1, F.lit("B")).otherwise(F.lit("C")).alias("grupo"),
        F.element_at(F.array(*[F.lit(x) for x in ("1", "2", "3a", "4", "S")]), s % 5 + 1).alias("nivel"),
    )
    return rows.groupBy("grupo", "nivel", X.kei("grupo", "nivel").alias("kei")).agg(F.count("*").alias("ucs"))


@query("dedup_first", """
SELECT * EXCLUDE rn FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS preco,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1""")
def dedup_first(t):
    """WIN-02/03: one row per key, first in a total order."""
    one = R.first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return one.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("preco"))


@query("dedup_latest", """
SELECT * EXCLUDE rn FROM (
  SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS momento,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def dedup_latest(t):
    """WIN-04/08: newest row per key, nulls last."""
    one = R.first_per_key(t.events, ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.desc("event_id")])
    return one.select("user_id", "event_type", "event_id", iso_text("ts").alias("momento"))


@query("dedup_incomplete_keys", B.with_(B.RAW) + """
SELECT count(*) AS linhas, count(NUM_POSTO_UCI) AS com_posto, count(DISTINCT NUM_INTRP_UCI || NUM_UC_UCI) AS pares FROM (
  SELECT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI FROM raw WHERE NUM_POSTO_UCI IS NULL
  UNION ALL SELECT DISTINCT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI FROM raw WHERE NUM_POSTO_UCI IS NOT NULL)""")
def dedup_incomplete_keys(t):
    """WIN-07: dedup of complete keys, rows with an incomplete key all kept."""
    one = R.dedup_keep_incomplete(B.raw(t).select(*S.RECORD_KEY, "arquivo_csv"), S.RECORD_KEY, ["arquivo_csv"])
    return one.agg(
        F.count("*").alias("linhas"), F.count("NUM_POSTO_UCI").alias("com_posto"),
        F.countDistinct(F.concat("NUM_INTRP_UCI", "NUM_UC_UCI")).alias("pares"),
    )


@query("merge_month", """
WITH existing AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
staged AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, 'existente' AS origem FROM existing
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'novo' FROM staged
WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM existing)""")
def merge_month(t):
    """SET-02, WIN-01: existing rows win over new ones."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    old = rows.where("l_returnflag = 'A'").drop("l_returnflag").withColumn("origem", F.lit("existente"))
    old = R.first_per_key(old, ["l_orderkey", "l_linenumber"], ["l_partkey"])
    new = rows.where("l_returnflag <> 'A'").drop("l_returnflag").withColumn("origem", F.lit("novo"))
    return marts.merge_month(new, old, ["l_orderkey", "l_linenumber"], tiebreak=["l_partkey"])


@query("union_mart", B.with_(B.RAW, B.UNI) + f"""
SELECT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI, arquivo_csv, ANOMES_PROCESSAMENTO, REGIONAL_ORIGEM, KVA_INTRP,
       strftime({B.INI}, '%Y-%m-%d %H:%M:%S') AS inicio, strftime({B.FIM}, '%Y-%m-%d %H:%M:%S') AS fim,
       strftime({B.INI_UC}, '%Y-%m-%d %H:%M:%S') AS inicio_uc, round(duracao, 6) AS duracao, erro_duracao, duracao_longa FROM uni""")
def union_mart(t):
    """PIP-02: all months, one row per record key, typed times, duration, flags, region."""
    return B.uni(t).select(
        *S.RECORD_KEY, "arquivo_csv", "ANOMES_PROCESSAMENTO", "REGIONAL_ORIGEM", "KVA_INTRP", iso_text(B.INI).alias("inicio"),
        iso_text(B.FIM).alias("fim"), iso_text(B.INI_UC).alias("inicio_uc"), F.round("duracao", 6).alias("duracao"),
        "erro_duracao", "duracao_longa",
    )


@query("month_window", B.with_(B.RAW, B.UNI) + f"""
SELECT m AS mes, cancel AS sem_canceladas, count(*) AS linhas, count(DISTINCT NUM_UC_UCI) AS ucs, round(sum(duracao), 4) AS minutos
FROM uni JOIN (SELECT unnest(['202401', '202402', '202403']) AS m) ON true JOIN (SELECT unnest([true, false]) AS cancel) ON true
WHERE {B.INI} >= strptime(m || '01', '%Y%m%d') AND {B.INI} < strptime(m || '01', '%Y%m%d') + INTERVAL 1 MONTH
  AND {B.FIM} >= strptime(m || '01', '%Y%m%d') AND {B.FIM} < strptime(m || '01', '%Y%m%d') + INTERVAL 1 MONTH
  AND (NOT cancel OR ESTADO_INTRP IS NULL OR ESTADO_INTRP <> '7') GROUP BY 1, 2""")
def month_window(t):
    """PIP-03, FLT-01/03: both times inside each month of the table, with and without cancelled events."""
    out = []
    for month in ("202401", "202402", "202403"):
        for cancel in (True, False):
            rows = marts.assess_month(B.uni(t), month, B.RUN_TS, drop_cancelled=cancel)
            out.append(rows.groupBy(F.col("MES_APURACAO").alias("mes"), F.lit(cancel).alias("sem_canceladas")).agg(
                F.count("*").alias("linhas"), F.countDistinct("NUM_UC_UCI").alias("ucs"), F.round(F.sum("duracao"), 4).alias("minutos")))
    return R.stack(*out)


_LOG_SQL = """log AS (
  SELECT CASE WHEN l_quantity > 20 THEN CAST(100000 + o_orderkey AS VARCHAR) ELSE 'sem' END AS i, 'P' || CAST(l_partkey % 50 AS VARCHAR) AS p, CAST(l_partkey AS VARCHAR) AS u,
         CASE l_linenumber % 3 WHEN 0 THEN 'validado' WHEN 1 THEN 'rejeitado' ELSE NULL END AS status,
         l_shipdate AS momento, l_returnflag AS usuario
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _log(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Decisions about small quantities belong to no record of the table.
    known = F.when(F.col("l_quantity") > 20, (F.col("o_orderkey") + 100000).cast("string")).otherwise(F.lit("sem"))
    key = F.concat_ws("|", known, F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")),
                      F.col("l_partkey").cast("string"))
    return rows.select(
        key.alias("chave_registro"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("validado")).when(F.col("l_linenumber") % 3 == 1, F.lit("rejeitado")).alias("status_validacao"),
        (F.col("l_linenumber") % 3 == 0).alias("validado"), F.col("l_shipdate").alias("data_hora"), F.col("l_returnflag").alias("usuario"),
    )


@query("latest_decision", B.with_(B.RAW, B.UNI, _LOG_SQL) + """
SELECT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI, coalesce(status = 'validado', false) AS validado, coalesce(status, 'pendente') AS status_validacao,
       usuario AS usuario_validacao, strftime(momento, '%Y-%m-%d') AS quando
FROM uni LEFT JOIN (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY i, p, u ORDER BY momento DESC NULLS LAST,
  coalesce(status, 'pendente'), usuario) AS rn FROM log) WHERE rn = 1) g ON g.i = NUM_INTRP_UCI AND g.p = NUM_POSTO_UCI AND g.u = NUM_UC_UCI""")
def latest_decision(t):
    """PIP-04, WIN-04, JN-12: latest decision per record key with defaults."""
    return marts.apply_governance(B.uni(t), _log(t)).select(
        *S.RECORD_KEY, "validado", "status_validacao", "usuario_validacao", F.date_format("data_hora_validacao", "yyyy-MM-dd").alias("quando")
    )


@query("billed_semi", """
SELECT o_orderpriority, count(*) AS pedidos, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def billed_semi(t):
    """JN-13: semi-join with a list of billed keys."""
    return t.orders.join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").groupBy(
        "o_orderpriority").agg(F.count("*").alias("pedidos"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("decisions_log", """
WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '|' || event_type AS chave_registro FROM events)
SELECT chave_registro, 'rejeitar' AS acao, 'rejeitado' AS status_validacao, false AS validado, 'aplicado' AS status, 'ana' AS usuario,
       'fora da regra' AS justificativa FROM k""")
def decisions_log(t):
    """PIP-29: a batch of decisions and the change-log rows it sets."""
    keys = t.events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("chave_registro"))
    rows = deploy.register_decisions(keys, "202401", "sobreposicao_uc", "rejeitar", " fora da regra ", "ana", "gestor", B.RUN_TS)
    return deploy.governance_entries(rows).select("chave_registro", "acao", "status_validacao", "validado", "status", "usuario", "justificativa")


@query("decision_counts", """
WITH d AS (SELECT CASE event_type WHEN 'error' THEN 'rejeitar' WHEN 'signup' THEN 'ignorar_regra' ELSE 'validar' END AS acao,
                  'regra_' || (user_id % 4) AS regra FROM events),
r AS (SELECT acao, regra, count(*) AS total FROM d GROUP BY 1, 2)
SELECT acao, regra, total FROM r UNION ALL SELECT acao, 'TODAS', CAST(sum(total) AS BIGINT) FROM r GROUP BY 1""")
def decision_counts(t):
    """AGG-30: decisions by action and by rule."""
    acao = F.when(F.col("event_type") == "error", F.lit("rejeitar")).when(F.col("event_type") == "signup", F.lit("ignorar_regra")).otherwise(F.lit("validar"))
    return deploy.decision_counts(t.events.select(acao.alias("acao"), F.concat(F.lit("regra_"), (F.col("user_id") % 4).cast("string")).alias("regra")))


@query("change_requests", """
SELECT CASE WHEN user_id % 3 = 0 THEN 'aplicado' ELSE 'solicitado' END AS status, count(*) AS pedidos,
       count(DISTINCT event_id) AS ids FROM events GROUP BY 1""")
def change_requests(t):
    """PIP-29 (request form): status by role; ids follow from the content."""
    role = F.when(F.col("user_id") % 3 == 0, F.lit("gestor")).otherwise(F.lit("analista"))
    rows = t.events.select(
        role.alias("perfil"), F.col("user_id").cast("string").alias("usuario"), F.col("event_id").cast("string").alias("chave_registro"),
        F.lit("COD_CAUSA_INTRP").alias("campo"), F.col("event_type").alias("valor_novo"), F.col("ts").cast("string").alias("criado_em"),
    )
    return deploy.change_requests(rows).groupBy("status").agg(F.count("*").alias("pedidos"), F.countDistinct("id_alteracao").alias("ids"))


@query("regional_export_counts", B.with_(B.RAW) + """
SELECT coalesce(nullif(trim(REGIONAL_ORIGEM), ''), 'SEM_REGIONAL') AS regional, count(*) AS linhas FROM raw GROUP BY 1""")
def regional_export_counts(t):
    """SNK-03: rows per region of the export."""
    return sinks.export_counts(B.raw(t))


@query("top_by_value", """
SELECT CAST(c_custkey AS BIGINT) AS uc, round(c_acctbal, 2) AS valor FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100""")
def top_by_value(t):
    """SRT-03, SRT-01: top page by value, nulls last, ties by UC."""
    rows = t.customer.select(F.col("c_custkey").alias("uc"), F.col("c_acctbal").alias("_v"))
    return R.paged(rows, [F.desc_nulls_last("_v"), F.asc("uc")], 100).select("uc", F.round("_v", 2).alias("valor"))
