"""Documented analyses over events, orders and the union mart."""

from pyspark.sql import functions as F

from ..functions.time import minute_boundaries
from ..operators import relational as R
from ..plans import anomalies as A
from . import relations as B
from .registry import query


@query("longest_per_group", B.with_(B.RAW, B.UNI) + f"""
SELECT NUM_OPER_CHV_INTRP AS grupo, NUM_SEQ_INTRP AS seq, posicao, round(duracao, 6) AS duracao FROM (
  SELECT *, row_number() OVER (PARTITION BY NUM_OPER_CHV_INTRP ORDER BY duracao DESC NULLS LAST, NUM_SEQ_INTRP, NUM_UC_UCI, NUM_POSTO_UCI NULLS LAST) AS posicao FROM uni)
WHERE posicao <= 3""")
def longest_per_group(t):
    """DOC-01: longest rows of each group."""
    return A.longest_per_group(B.uni(t), "NUM_OPER_CHV_INTRP", "duracao", 3, ("NUM_SEQ_INTRP", "NUM_UC_UCI", "NUM_POSTO_UCI")).select(
        F.col("NUM_OPER_CHV_INTRP").alias("grupo"), F.col("NUM_SEQ_INTRP").alias("seq"), "posicao", F.round("duracao", 6).alias("duracao"))


@query("mean_3_sigma", """
WITH d AS (SELECT event_type AS conjunto, CAST(ts AS DATE) AS dia, count(DISTINCT user_id) AS n FROM events WHERE value < 400 GROUP BY 1, 2),
s AS (SELECT conjunto, avg(n) AS m, coalesce(stddev_samp(n), 0) AS sd FROM d WHERE dia < DATE '2024-01-11' GROUP BY 1)
SELECT conjunto, strftime(dia, '%Y-%m-%d') AS dia, n AS qtd_servicos, round(m, 6) AS media_hist, round(sd, 6) AS desvio_hist, coalesce(n > m + 3 * sd, false) AS flag_anomalia
FROM d LEFT JOIN s USING (conjunto)""")
def mean_3_sigma(t):
    """DOC-02: days above mean + 3 sigma of the history."""
    rows = t.events.withColumnRenamed("event_type", "conjunto")
    daily = A.services_per_day(rows, "conjunto", "ts", "user_id", excluded=F.col("value") >= 400)
    out = A.critical_days(daily, "conjunto", history=F.col("dia") < F.lit("2024-01-11").cast("date"))
    return out.select("conjunto", F.date_format("dia", "yyyy-MM-dd").alias("dia"), "qtd_servicos", F.round("media_hist", 6).alias("media_hist"),
                      F.round("desvio_hist", 6).alias("desvio_hist"), "flag_anomalia")


@query("daily_steps", """
WITH b AS (SELECT o_orderpriority AS conjunto, CAST(o_orderdate AS DATE) AS dia, sum(o_totalprice) / 1e6 AS d, count(*) AS f FROM orders GROUP BY 1, 2),
c AS (SELECT *, sum(d) OVER m AS da, sum(f) OVER m AS fa, sum(d) OVER y AS dy, sum(f) OVER y AS fy FROM b
  WINDOW m AS (PARTITION BY conjunto, strftime(dia, '%Y%m') ORDER BY dia ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY conjunto, year(dia) ORDER BY dia ROWS UNBOUNDED PRECEDING)),
t AS (SELECT o_orderpriority AS conjunto, max(o_totalprice) / 1e5 AS md, CAST(count(*) / 7.0 AS DOUBLE) AS mf FROM orders GROUP BY 1),
r AS (SELECT c.conjunto, dia, da - coalesce(lag(da) OVER w, 0) AS sd, fa - coalesce(lag(fa) OVER w, 0) AS sf, md, mf, dy, fy,
        CASE WHEN dayofyear(make_date(year(dia), 12, 31)) = 366 THEN 366.0 ELSE 365.0 END AS n
  FROM c JOIN t ON t.conjunto = c.conjunto WINDOW w AS (PARTITION BY c.conjunto, strftime(dia, '%Y%m') ORDER BY dia)),
z AS (SELECT *, sd / (md / n) AS rd, sf / (mf / n) AS rf FROM r)
SELECT conjunto, strftime(dia, '%Y-%m-%d') AS dia, round(rd, 4) AS razao_dec, round(rf, 4) AS razao_fec,
       CASE WHEN rd >= 2 OR rf >= 2 THEN 'ALTA' WHEN (rd > 1 AND dy > md) OR (rf > 1 AND fy > mf) THEN 'MEDIA' ELSE 'SEM_PRIORIDADE' END AS prioridade FROM z""")
def daily_steps(t):
    """DOC-03: daily step against the daily target, with priority. Windows run over one row per group and day."""
    from pyspark.sql import Window
    base = t.orders.groupBy(F.col("o_orderpriority").alias("conjunto"), F.to_date("o_orderdate").alias("dia")).agg(
        (F.sum("o_totalprice") / 1e6).alias("d"), F.count("*").alias("f"))
    month = Window.partitionBy("conjunto", F.date_format("dia", "yyyyMM")).orderBy("dia").rowsBetween(Window.unboundedPreceding, 0)
    year = Window.partitionBy("conjunto", F.year("dia")).orderBy("dia").rowsBetween(Window.unboundedPreceding, 0)
    daily = base.select("conjunto", "dia", F.sum("d").over(month).alias("dec_acum_mensal"), F.sum("f").over(month).alias("fec_acum_mensal"),
                        F.sum("d").over(year).alias("dec_acum_anual"), F.sum("f").over(year).alias("fec_acum_anual"))
    targets = t.orders.groupBy(F.col("o_orderpriority").alias("conjunto")).agg(
        (F.max("o_totalprice") / 1e5).alias("meta_dec"), (F.count("*") / 7.0).alias("meta_fec"))
    return A.daily_steps(daily, targets).select(
        "conjunto", F.date_format("dia", "yyyy-MM-dd").alias("dia"), F.round("razao_dia_meta_dec", 4).alias("razao_dec"),
        F.round("razao_dia_meta_fec", 4).alias("razao_fec"), "prioridade")


@query("impact_rules", B.with_(B.EV, """r AS (SELECT seq, date_diff('minute', inicio, fim) AS m, CASE protocolo WHEN 'click' THEN '1' WHEN 'error' THEN '6' ELSE '0' END AS p, uc % 3 AS ci FROM ev)""") + """
SELECT seq, 'ERRO_GRAVE_DURACAO_CURTA_COM_IMPACTO' AS regra, 'P0' AS severidade FROM r WHERE m < 3 AND ci > 0
UNION ALL SELECT seq, 'ERRO_GRAVE_PROTOCOLO_1_COM_IMPACTO_LIQUIDO', 'P0' FROM r WHERE p = '1' AND ci > 0
UNION ALL SELECT seq, 'ALERTA_PROTOCOLO_6_COM_IMPACTO_LIQUIDO', 'BAIXA' FROM r WHERE p = '6' AND ci > 0""")
def impact_rules(t):
    """DOC-04: net impact where none is expected."""
    rows = B.ev(t).select(
        "seq", minute_boundaries("inicio", "fim").alias("duracao_min"), (F.col("uc") % 3).alias("ci_liquido"), F.lit(0.0).alias("chi_liquido"),
        F.when(F.col("protocolo") == "click", F.lit("1")).when(F.col("protocolo") == "error", F.lit("6")).otherwise(F.lit("0")).alias("tipo_protocolo"))
    return A.impact_rules(rows).select("seq", "regra", "severidade")


@query("service_impact", B.with_(B.EV) + """
SELECT seq, CASE WHEN uc % 2 = 0 THEN uc ELSE 0 END AS ci_servico, CASE WHEN uc % 2 <> 0 THEN 0 WHEN seq % 10 = 0 THEN NULL
       ELSE round(uc * (epoch(date_trunc('second', fim)) - epoch(date_trunc('second', inicio))) / 3600.0, 6) END AS chi_servico,
       uc % 2 = 0 AND seq % 10 = 0 AS verificar_termino FROM ev""")
def service_impact(t):
    """DOC-05: CI and CHI of finished services."""
    rows = B.ev(t).select(
        "seq", F.col("uc").alias("consumidores"), "inicio", F.when(F.col("seq") % 10 != 0, F.col("fim")).alias("fim"),
        F.when(F.col("uc") % 2 == 0, F.lit("14")).otherwise(F.lit("3")).alias("status_servico"))
    return A.service_impact(rows).select("seq", "ci_servico", F.round("chi_servico", 6).alias("chi_servico"), "verificar_termino")


@query("distance_to_history", """
WITH s AS (SELECT event_type, user_id, avg(value) AS m1, stddev_samp(value) AS s1, avg(len) AS m2, stddev_samp(len) AS s2 FROM (SELECT *, CAST(event_id % 17 AS DOUBLE) AS len FROM events) GROUP BY 1, 2)
SELECT event_id, round(coalesce((value - m1) / nullif(s1, 0), 0), 5) AS z_valor,
       round(sqrt(coalesce((value - m1) / nullif(s1, 0), 0) ** 2 + coalesce((event_id % 17 - m2) / nullif(s2, 0), 0) ** 2), 5) AS distancia
FROM events JOIN s USING (event_type, user_id)""")
def distance_to_history(t):
    """DOC-07: z-scores and Euclidean distance to the group's history."""
    rows = t.events.select("event_id", "event_type", "user_id", F.col("value").alias("valor"), (F.col("event_id") % 17).cast("double").alias("len"))
    return A.distance_to_history(rows, ["event_type", "user_id"], ["valor", "len"]).select(
        "event_id", F.round("z_valor", 5).alias("z_valor"), F.round("distancia", 5).alias("distancia"))


_SNAP = """old AS (SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
new AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 20 = 3 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 30 = 3 THEN NULL ELSE o_orderpriority END AS p
  FROM orders)"""


def _snapshots(t):
    k = F.col("o_orderkey")
    # A row whose key changes between the states has left under the one and come under the other.
    other = lambda priority: F.when((F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == "P"), -k).otherwise(k).alias("k")
    old = t.orders.select(other("5-LOW"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    new = t.orders.select(
        other("1-URGENT"), F.when(k % 20 == 3, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 30 != 3, F.col("o_orderpriority")).alias("p"))
    return old, new


@query("snapshot_diff", B.with_(_SNAP) + """
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'INCLUSAO' ELSE 'EXCLUSAO' END AS tipo_alteracao, '*' AS campo, NULL::VARCHAR AS valor_anterior, NULL::VARCHAR AS valor_atual
FROM old o FULL OUTER JOIN new n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL
UNION ALL SELECT o.k, 'ALTERACAO', 's', o.s, n.s FROM old o JOIN new n ON o.k = n.k WHERE o.s IS DISTINCT FROM n.s
UNION ALL SELECT o.k, 'ALTERACAO', 'p', o.p, n.p FROM old o JOIN new n ON o.k = n.k WHERE o.p IS DISTINCT FROM n.p""")
def snapshot_diff(t):
    """DOC-09: added, removed and changed fields between two states of a table."""
    old, new = _snapshots(t)
    return A.snapshot_diff(old, new, ["k"], ["s", "p"])


@query("effect_of_proposal", B.with_(_SNAP, """prop AS (SELECT o_orderkey AS k, 'X' AS s, o_orderpriority AS p FROM orders)""") + """
SELECT pr.k, o.s AS s_original, pr.s AS s_proposto, n.s AS s_efetivado,
       CASE WHEN n.k IS NULL THEN 'NAO_ENCONTRADO' WHEN pr.s IS NOT DISTINCT FROM n.s AND pr.p IS NOT DISTINCT FROM n.p THEN 'IGUAL'
            WHEN pr.s IS DISTINCT FROM n.s AND pr.p IS DISTINCT FROM n.p THEN 'DIVERGENTE' ELSE 'PARCIALMENTE_EFETIVADO' END AS resultado
FROM prop pr LEFT JOIN old o ON o.k = pr.k LEFT JOIN new n ON n.k = pr.k""")
def effect_of_proposal(t):
    """DOC-10: original, proposed and effective values with the outcome."""
    old, new = _snapshots(t)
    prop = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("X").alias("s"), F.col("o_orderpriority").alias("p"))
    return A.effect_of_proposal(old, prop, new, ["k"], ["s", "p"]).select("k", "s_original", "s_proposto", "s_efetivado", "resultado")


@query("equipment_signature", B.with_(B.EV) + """
SELECT g.uc, eventos, round(media, 6) AS duracao_media, maior AS duracao_max, causa_tipica, round(eventos / dias, 6) AS reincidencia FROM (
  SELECT uc, count(DISTINCT seq) AS eventos, avg(date_diff('minute', inicio, fim)) AS media, max(date_diff('minute', inicio, fim)) AS maior,
         count(DISTINCT CAST(inicio AS DATE)) AS dias FROM ev GROUP BY 1) g
JOIN (SELECT uc, protocolo AS causa_tipica FROM (SELECT uc, protocolo, row_number() OVER (PARTITION BY uc ORDER BY count(*) DESC, protocolo) AS rn FROM ev GROUP BY 1, 2) WHERE rn = 1) m ON m.uc = g.uc""")
def equipment_signature(t):
    """DOC-11: typical cause, duration and recurrence of equipment."""
    rows = B.ev(t).withColumn("m", minute_boundaries("inicio", "fim"))
    return A.equipment_signature(rows, ["uc"], "protocolo", "m", "seq").select(
        "uc", "eventos", F.round("duracao_media", 6).alias("duracao_media"), "duracao_max", "causa_tipica", F.round("reincidencia", 6).alias("reincidencia"))


@query("protocol_minimum", B.with_(B.EV) + """
SELECT protocolo, round(sum(date_diff('minute', inicio, fim) / 60.0 * uc), 3) AS chi_total, count(*) AS eventos,
       sum(date_diff('minute', inicio, fim) / 60.0 * uc) >= 700000 AS atinge_minimo FROM ev GROUP BY 1""")
def protocol_minimum(t):
    """DOC-12: customer hours per protocol against the minimum."""
    rows = B.ev(t).withColumn("chi", minute_boundaries("inicio", "fim") / F.lit(60.0) * F.col("uc"))
    return A.protocol_minimum(rows, "protocolo", "chi").select("protocolo", F.round("chi_total", 3).alias("chi_total"), "eventos", "atinge_minimo")


@query("protocol_candidates", B.with_(B.EV) + """
SELECT protocolo, seq, posicao, round(chi, 4) AS chi, chi >= 2000 AS revisao_obrigatoria FROM (
  SELECT protocolo, seq, chi, row_number() OVER (PARTITION BY protocolo ORDER BY chi DESC, seq) AS posicao
  FROM (SELECT *, date_diff('minute', inicio, fim) / 60.0 * uc AS chi FROM ev)) WHERE posicao <= 10""")
def protocol_candidates(t):
    """DOC-12: ranked candidates with the review mark."""
    rows = B.ev(t).withColumn("chi", minute_boundaries("inicio", "fim") / F.lit(60.0) * F.col("uc"))
    return A.protocol_candidates(rows, "protocolo", "chi", 10, ("seq",)).select("protocolo", "seq", "posicao", F.round("chi", 4).alias("chi"), "revisao_obrigatoria")


@query("complaints", """
WITH u AS (SELECT event_type, CAST(ts AS DATE) AS dia, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT event_type, strftime(dia, '%Y-%m-%d') AS dia, CAST(sum(n) AS BIGINT) AS qtd_reclamacoes, count(*) AS qtd_ucs, count(*) FILTER (n = 2) AS qtd_uc_com_2_reclamacoes,
       count(*) FILTER (n = 3) AS qtd_uc_com_3_reclamacoes, count(*) FILTER (n > 3) AS qtd_uc_com_mais_de_3_reclamacoes FROM u GROUP BY 1, 2""")
def complaints(t):
    """DOC-13: repeated complaints per group and day."""
    return A.complaints(t.events, ["event_type"], "user_id", "ts").withColumn("dia", F.date_format("dia", "yyyy-MM-dd"))


@query("topology_coverage", """
SELECT o_orderpriority, count(*) AS reclamacoes, count(t.k) AS com_topologia, round(count(t.k) / count(*), 6) AS cobertura
FROM orders LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) t ON t.k = o_custkey GROUP BY 1""")
def topology_coverage(t):
    """DOC-13: share of complaints with a topology row."""
    topo = t.events.select(F.col("user_id").alias("uc")).distinct()
    rows = t.orders.withColumnRenamed("o_custkey", "uc")
    return A.topology_coverage(rows, topo, ["o_orderpriority"]).withColumn("cobertura", F.round("cobertura", 6))


@query("latest_topology", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_topology(t):
    """DOC-14: newest row per UC by partial maxima."""
    return A.latest_topology(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("suggest_codes", B.with_(B.RAW, B.UNI, f"""hist AS (SELECT NUM_OPER_CHV_INTRP AS d, COD_CAUSA_INTRP AS c, count(*) AS n FROM uni WHERE NOT {B.BLANK('COD_CAUSA_INTRP')} GROUP BY 1, 2),
best AS (SELECT d, c FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, c) AS rn FROM hist) WHERE rn = 1)""") + f"""
SELECT NUM_INTRP_UCI, NUM_POSTO_UCI, NUM_UC_UCI, c AS "COD_CAUSA_INTRP_sugerido" FROM uni LEFT JOIN best ON d = NUM_OPER_CHV_INTRP WHERE {B.BLANK('COD_CAUSA_INTRP')}""")
def suggest_codes(t):
    """DOC-16: most frequent cause of the same device for records without one."""
    from ..functions.text import is_blank
    rows = B.uni(t)
    return A.suggest_codes(rows.where(is_blank("COD_CAUSA_INTRP")), rows.where(~is_blank("COD_CAUSA_INTRP")), ["NUM_OPER_CHV_INTRP"], "COD_CAUSA_INTRP").select(
        "NUM_INTRP_UCI", "NUM_POSTO_UCI", "NUM_UC_UCI", "COD_CAUSA_INTRP_sugerido")


@query("event_quantiles", """
SELECT event_type, round(quantile_cont(value, 0.25), 5) AS p25, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY 1""")
def event_quantiles(t):
    """AUD-08 on the event stream: exact quantiles without holding a group in one task."""
    out = R.exact_quantiles(t.events, ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    return out.withColumns({c: F.round(c, 5) for c in ("p25", "p50", "p95")})
