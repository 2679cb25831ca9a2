"""Indicators, compensation and audits."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators.relational import stack
from ..plans import audit as A
from ..plans import compensation as C
from ..plans import indicators as I
from . import relations as B
from .quality_queries import treated
from .registry import query


def _round(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def base(t):
    return I.scenario_base(B.uni(t), treated(t), "202402")


def billed_base(t):
    return I.billed_filter(base(t), B.billed(t))


def uc(t):
    return t.stage("indicadores_uc", lambda: I.uc_indicators(billed_base(t), B.RUN_TS, S.DENOMINATOR_BILLED))


@query("indicators_uc", B.with_(*B.INDICATORS) + """
SELECT cenario, regional_origem, cod_conjunto_aneel, num_posto_uci, num_uc_uci, round(dic_horas, 6) AS dic_horas, fic,
       round(dmic_horas, 6) AS dmic_horas, interrupcoes_distintas, 'APLICADO_UC_FATURADA_HCAI' AS filtro_faturamento FROM netuc""")
def indicators_uc(t):
    """AGG-06, FLT-06, JN-13, PIP-13: DIC, FIC, DMIC per UC, both scenarios."""
    rows = I.uc_indicators(billed_base(t), B.RUN_TS, S.DENOMINATOR_BILLED)
    return _round(rows, 6, "dic_horas", "dmic_horas").select(
        "cenario", "regional_origem", "cod_conjunto_aneel", "num_posto_uci", "num_uc_uci", "dic_horas", "fic", "dmic_horas",
        "interrupcoes_distintas", "filtro_faturamento")


def dens(t):
    return I.denominators(billed_base(t), B.official(t))


@query("denominators", B.with_(*B.INDICATORS, B.OFFICIAL, B.LEVELS) + "SELECT cenario, regional_origem, q AS quantidade_ucs FROM dens")
def denominators(t):
    """AGG-11/12, JN-14: official UC counts with distinct UCs as fallback."""
    return dens(t)


LEVEL_SQL = B.with_(*B.INDICATORS, B.OFFICIAL, B.LEVELS)


def levels(t):
    return t.stage("levels", lambda: I.aggregate_levels(uc(t), dens(t), B.RUN_TS))


@query("indicators_levels", LEVEL_SQL + """
SELECT cenario, nivel, regional_origem, cod_conjunto_aneel, quantidade_ucs, round(soma_dic_horas, 4) AS soma_dic_horas, soma_fic,
       round(soma_dic_horas / nullif(quantidade_ucs, 0), 6) AS dec_horas, round(soma_fic / nullif(quantidade_ucs, 0), 6) AS fec,
       round(dmic_max_horas, 6) AS dmic_max_horas FROM levels""")
def indicators_levels(t):
    """AGG-07..10, JN-15: DEC and FEC for company, regions and sets."""
    rows = _round(I.aggregate_levels(uc(t), dens(t), B.RUN_TS), 6, "dec_horas", "fec", "dmic_max_horas")
    return _round(rows, 4, "soma_dic_horas").select(
        "cenario", "nivel", "regional_origem", "cod_conjunto_aneel", "quantidade_ucs", "soma_dic_horas", "soma_fic", "dec_horas", "fec",
        "dmic_max_horas")


@query("before_after", LEVEL_SQL + """, lv AS (SELECT *, soma_dic_horas / nullif(quantidade_ucs, 0) AS dec_horas, soma_fic / nullif(quantidade_ucs, 0) AS fec FROM levels)
SELECT coalesce(a.nivel, d.nivel) AS nivel, coalesce(a.regional_origem, d.regional_origem) AS regional_origem,
       coalesce(a.cod_conjunto_aneel, d.cod_conjunto_aneel) AS cod_conjunto_aneel, coalesce(d.quantidade_ucs, a.quantidade_ucs) AS quantidade_ucs,
       round(a.dec_horas, 6) AS dec_antes, round(d.dec_horas, 6) AS dec_depois, round(d.dec_horas - a.dec_horas, 6) AS dec_delta,
       round((d.fec - a.fec) / nullif(a.fec, 0) * 100, 4) AS fec_delta_percentual, round(d.dmic_max_horas - a.dmic_max_horas, 6) AS dmic_delta
FROM (SELECT * FROM lv WHERE cenario = 'antes') a FULL OUTER JOIN (SELECT * FROM lv WHERE cenario = 'depois') d
  ON a.nivel = d.nivel AND a.regional_origem = d.regional_origem AND a.cod_conjunto_aneel = d.cod_conjunto_aneel""")
def before_after(t):
    """JN-16, SET-03: both scenarios side by side."""
    rows = _round(I.before_after(levels(t), B.RUN_TS), 6, "dec_antes", "dec_depois", "dec_delta", "dmic_delta")
    return _round(rows, 4, "fec_delta_percentual").select(
        "nivel", "regional_origem", "cod_conjunto_aneel", "quantidade_ucs", "dec_antes", "dec_depois", "dec_delta", "fec_delta_percentual",
        "dmic_delta")


def _ev_rows(t):
    """Event-stream intervals as scenario rows: five regions, contained events removed afterwards."""
    from ..operators.intervals import contained
    rows = contained(B.ev(t), ["uc"], "seq", "seq", once=True).withColumn("cenario", F.explode(F.when(
        F.col("contido"), F.array(F.lit("antes"))).otherwise(F.array(F.lit("antes"), F.lit("depois")))))
    regions = F.array(*[F.lit(r) for r in S.REGIONS])
    return rows.select(
        "cenario", F.lit("202401").alias("anomes"), F.element_at(regions, (F.col("uc") % 5 + 1).cast("int")).alias("regional_origem"),
        F.col("protocolo").alias("cod_conjunto_aneel"), F.lit("P").alias("num_posto_uci"), F.col("uc").cast("string").alias("num_uc_uci"),
        F.col("seq").cast("string").alias("num_seq_intrp"), F.lit(None).cast("string").alias("num_intrp_inic_manobra_uci"),
        F.col("inicio").alias("inicio_uc"), F.col("fim").alias("fim_uc"), F.lit("4").alias("estado_intrp"), F.lit(None).cast("string").alias("motivo_tratamento"),
        F.lit("0").alias("tipo_protocolo_uci"), F.lit(None).cast("string").alias("indic_sit_proces_indic_uci"),
        I.minute_boundaries("inicio", "fim").alias("duracao_minutos_uc"),
    )


@query("indicators_region", B.with_(B.EV, """r AS (
  SELECT *, ['CSL','LES','NRO','NRT','OES'][uc % 5 + 1] AS regional_origem, date_diff('minute', inicio, fim) AS m,
         EXISTS (SELECT 1 FROM ev b WHERE a.uc = b.uc AND a.seq <> b.seq AND b.inicio <= a.inicio AND b.fim >= a.fim
           AND (b.inicio < a.inicio OR b.fim > a.fim OR b.seq < a.seq)) AS contido FROM ev a),
s AS (SELECT 'antes' AS cenario, * FROM r UNION ALL SELECT 'depois', * FROM r WHERE NOT contido)""") + """
SELECT cenario, regional_origem, count(DISTINCT uc) AS ucs, round(sum(m) / 60.0, 4) AS dic_horas, count(DISTINCT seq) AS fic,
       round(max(m) / 60.0, 6) AS dmic_horas FROM s WHERE m >= 3 GROUP BY 1, 2""")
def indicators_region(t):
    """AGG-06..07 over the event stream, contained events removed in the second scenario."""
    per_uc = I.uc_indicators(_ev_rows(t), B.RUN_TS)
    one = per_uc.groupBy("cenario", "regional_origem", "num_uc_uci").agg(
        F.sum("dic_horas").alias("d"), F.sum("fic").alias("f"), F.max("dmic_horas").alias("x"))
    return one.groupBy("cenario", "regional_origem").agg(
        F.count("*").alias("ucs"), F.round(F.sum("d"), 4).alias("dic_horas"), F.sum("f").alias("fic"), F.round(F.max("x"), 6).alias("dmic_horas"))


# ------------------------------------------------------------------------------------------ CI/CHI

_CC_COLS = ["arquivo_origem", "is_expurgo", "is_area_i", "ini", "fim", "u", "k1", "k2"]
CICHI = f"""ccrows AS (
  SELECT coalesce(trim(SIGLA_REGIONAL), '') AS o0, CASE WHEN o0 <> '' THEN o0 ELSE 'Copel' END AS arquivo_origem,
         (coalesce(trim(TIPO_PROTOC_JUSTIF_UCI), '') NOT IN ('', '0') OR coalesce(trim(TIPO_PROTOC_JUSTIF_INTRP), '') NOT IN ('', '0')) AS is_expurgo,
         coalesce(try_cast(COD_AREA_ELET_INTRP AS DOUBLE) <= 6, false) AS is_area_i, {B.INI_UC} AS ini, {B.FIM} AS fim,
         coalesce(nullif(trim(NUM_INTRP_INIC_MANOBRA_UCI), ''), NUM_INTRP_UCI) AS k1, coalesce(NUM_POSTO_UCI, '') AS k2, NUM_UC_UCI AS u,
         NUM_MOTIVO_TRAT_DIF_UCI AS motivo
  FROM uni),
ccf AS (SELECT * FROM ccrows WHERE is_expurgo OR {B.BLANK('motivo')}),
ccd AS (
  SELECT * EXCLUDE rn FROM (SELECT *, CASE WHEN k2 = '' THEN 1 ELSE row_number() OVER (PARTITION BY k1, k2, u ORDER BY fim DESC NULLS LAST, ini DESC NULLS LAST) END AS rn FROM ccf)
  WHERE rn = 1 AND ini IS NOT NULL AND fim >= ini),
ccm AS (
  SELECT s, o, u, p, date_diff('second', min(ini), max(fim)) / 60.0 AS m, bool_or(is_expurgo) AS e, bool_or(is_area_i) AS a FROM (
    SELECT *, sum(novo) OVER (PARTITION BY s, o, u ORDER BY ini, fim, k1, k2 ROWS UNBOUNDED PRECEDING) AS p FROM (
      SELECT *, CASE WHEN ini <= max(fim) OVER (PARTITION BY s, o, u ORDER BY ini, fim, k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS novo
      FROM (SELECT 'o' AS s, arquivo_origem AS o, * FROM ccd UNION ALL SELECT 'c', 'Copel', * FROM ccd)))
  GROUP BY 1, 2, 3, 4),
cca AS (
  SELECT s, o AS arquivo_origem, CASE WHEN e THEN 'Expurgo' ELSE 'Liquido' END AS classificacao, count(*) AS "CI", sum(m / 60.0) AS "CHI",
         count(*) FILTER (m >= 3) AS qtd_intrp_longas, count(*) FILTER (m < 3) AS qtd_intrp_curtas, coalesce(sum(m / 60.0) FILTER (m >= 3), 0) AS chi_l,
         coalesce(sum(m / 60.0) FILTER (m < 3), 0) AS chi_c, count(*) FILTER (m >= 3 AND a) AS ci_i, coalesce(sum(m / 60.0) FILTER (m >= 3 AND a), 0) AS chi_i
  FROM ccm WHERE u IN (SELECT uc FROM billed) GROUP BY 1, 2, 3),
evd AS (
  SELECT arquivo_origem, classificacao, count(DISTINCT oc) + max(CASE WHEN oc IS NULL THEN 1 ELSE 0 END) AS q1,
         count(DISTINCT pid) + max(CASE WHEN pid IS NULL THEN 1 ELSE 0 END) AS q2
  FROM (SELECT CASE WHEN coalesce(trim(SIGLA_REGIONAL), '') <> '' THEN trim(SIGLA_REGIONAL) ELSE 'Copel' END AS arquivo_origem,
               CASE WHEN coalesce(trim(TIPO_PROTOC_JUSTIF_INTRP), '') NOT IN ('', '0') THEN 'Expurgo' ELSE 'Liquido' END AS classificacao,
               NUM_OCORRENCIA_ADMS AS oc, PID AS pid FROM uni) GROUP BY GROUPING SETS ((1, 2), (2))),
cons AS (SELECT ['P','L','M','C','V'][c_custkey % 5 + 1] AS regional, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1),
ccs AS (
  SELECT a.*, coalesce(q1, 0) AS qtd_ocorrencias_distintas, coalesce(q2, 0) AS qtd_interrupcoes_distintas,
         CASE WHEN s = 'o' THEN n ELSE (SELECT sum(n) FROM cons) END AS consumidores
  FROM cca a LEFT JOIN evd ON evd.classificacao = a.classificacao AND CASE WHEN s = 'o' THEN evd.arquivo_origem = a.arquivo_origem ELSE evd.arquivo_origem IS NULL END
  LEFT JOIN cons ON s = 'o' AND cons.regional = a.arquivo_origem)"""
_CC_SELECT = """
SELECT s = 'c' AS empresa, arquivo_origem, classificacao, "CI", round("CHI", 4) AS "CHI", qtd_intrp_longas, qtd_intrp_curtas, qtd_ocorrencias_distintas,
       qtd_interrupcoes_distintas, consumidores, CASE WHEN consumidores > 0 THEN round(qtd_intrp_longas / consumidores, 6) ELSE 0 END AS "FEC",
       CASE WHEN consumidores > 0 THEN round(chi_l / consumidores, 6) ELSE 0 END AS "DEC",
       CASE WHEN consumidores > 0 THEN round(chi_c / consumidores, 6) ELSE 0 END AS "FM_dec",
       CASE WHEN consumidores > 0 THEN round(ci_i / consumidores, 6) ELSE 0 END AS "FECi",
       CASE WHEN consumidores > 0 THEN round(chi_i / consumidores, 6) ELSE 0 END AS "DECi" FROM ccs"""


@query("ci_chi_summary", B.with_(B.RAW, B.UNI, B.BILLED, CICHI) + _CC_SELECT)
def ci_chi_summary(t):
    """PIP-28, WIN-07/09/10, AGG-15..17, JN-13/18: CI/CHI by origin and company."""
    rows = B.uni(t).select(
        *S.RECORD_KEY, "SIGLA_REGIONAL", "TIPO_PROTOC_JUSTIF_UCI", "TIPO_PROTOC_JUSTIF_INTRP", "COD_AREA_ELET_INTRP", "NUM_MOTIVO_TRAT_DIF_UCI",
        "NUM_INTRP_INIC_MANOBRA_UCI", F.col(B.INI_UC).alias("DTHR_INICIO_INTRP_UC"), F.col(B.FIM).alias("DATA_HORA_FIM_INTRP"))
    letters = F.array(*[F.lit(x) for x in ("P", "L", "M", "C", "V")])
    cons = t.customer.groupBy(F.element_at(letters, (F.col("c_custkey") % 5 + 1).cast("int")).alias("regional")).agg(
        F.count("*").alias("consumidores")).withColumn("mes", F.lit(2))
    wanted = B.billed(t).where("faturado = 'S'").select("uc")
    out = I.assess_ci_chi(B.uni(t).select("SIGLA_REGIONAL", "TIPO_PROTOC_JUSTIF_INTRP", "NUM_OCORRENCIA_ADMS", "PID"), rows, wanted, cons,
                          tiebreak=[F.desc_nulls_last("DTHR_INICIO_INTRP_UC")])
    parts = stack(out["origem"].withColumn("empresa", F.lit(False)), out["empresa"].withColumn("empresa", F.lit(True)))
    rounded = _round(_round(parts, 4, "CHI"), 6, "FEC", "DEC", "FM_dec", "FECi", "DECi")
    return rounded.select(
        "empresa", "arquivo_origem", "classificacao", "CI", "CHI", "qtd_intrp_longas", "qtd_intrp_curtas", "qtd_ocorrencias_distintas",
        "qtd_interrupcoes_distintas", "consumidores", "FEC", "DEC", "FM_dec", "FECi", "DECi")


# ------------------------------------------------------------------------------------ compensation


def comp(t):
    return t.stage("comp", lambda: C.compensation(uc(t), B.targets(t), "202402", B.RUN_TS, B.vrcs(t)))


@query("compensation", B.with_(*B.MONEY) + """
SELECT uc, cenario, regional, conjunto_aneel, grupo_tensao, nivel_tensao, round(vrc, 2) AS vrc, kei, v1 AS viola_dic, v2 AS viola_fic, v3 AS viola_dmic,
       round(c1, 4) AS compensacao_dic, round(c2, 4) AS compensacao_fic, round(c3, 4) AS compensacao_dmic, viola AS possui_violacao,
       round(valor, 4) AS valor_ressarcimento_estimado FROM comp""")
def compensation(t):
    """PIP-14, JN-17, WIN-05, Q6, Q8: compensation per UC row, the largest violated indicator."""
    rows = C.compensation(uc(t), B.targets(t), "202402", B.RUN_TS, B.vrcs(t))
    rows = _round(rows, 4, "compensacao_dic", "compensacao_fic", "compensacao_dmic", "valor_ressarcimento_estimado")
    return _round(rows, 2, "vrc").select(
        "uc", "cenario", "regional", "conjunto_aneel", "grupo_tensao", "nivel_tensao", "vrc", "kei", "viola_dic", "viola_fic", "viola_dmic",
        "compensacao_dic", "compensacao_fic", "compensacao_dmic", "possui_violacao", "valor_ressarcimento_estimado")


def _v1(done, limit):
    return f"CASE WHEN v.vrc IS NULL THEN NULL WHEN coalesce({limit}, 0) <= 0 THEN 0 WHEN {done} > {limit} THEN v.vrc * ({done} / 730.0) * kei ELSE 0 END"


@query("compensation_excess", B.with_(*B.MONEY, f"""v1 AS (
  SELECT c.uc, c.cenario, greatest(dic_horas - l_dic, 0) AS e1, greatest(c.fic - l_fic, 0) AS e2, greatest(dmic_horas - l_dmic, 0) AS e3,
         {_v1('dic_horas', 'l_dic')} AS p1, {_v1('c.fic', 'l_fic')} AS p2, {_v1('dmic_horas', 'l_dmic')} AS p3
  FROM comp0 c LEFT JOIN vrcs v ON v.uc = c.uc)""") + """
SELECT uc AS num_uc_uci, cenario, round(e1, 6) AS excedente_dic_horas, round(e2, 6) AS excedente_fic, round(e3, 6) AS excedente_dmic_horas,
       coalesce(e1 > 0, false) OR coalesce(e2 > 0, false) OR coalesce(e3 > 0, false) AS possui_violacao, round(p1, 4) AS compensacao_dic,
       round(greatest(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0)), 4) AS valor_ressarcimento_estimado FROM v1""")
def compensation_excess(t):
    """PIP-15, AGG-13/14: earlier form with excess columns and zero guard per target."""
    rows = C.compensation_excess(uc(t), B.targets(t), B.RUN_TS, B.vrcs(t))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    rows = rows.withColumns({c: zero(c) for c in ("excedente_dic_horas", "excedente_fic", "excedente_dmic_horas")})
    return _round(rows, 4, "compensacao_dic", "valor_ressarcimento_estimado").select(
        "num_uc_uci", "cenario", "excedente_dic_horas", "excedente_fic", "excedente_dmic_horas", "possui_violacao", "compensacao_dic",
        "valor_ressarcimento_estimado")


@query("compensation_summary", B.with_(*B.MONEY) + """
SELECT cenario, regional, count(*) AS registros, count(DISTINCT uc) AS ucs, count(*) FILTER (viola) AS violacoes,
       count(DISTINCT CASE WHEN viola THEN uc END) AS ucs_com_violacao, round(sum(valor), 2) AS valor_estimado FROM comp GROUP BY 1, 2""")
def compensation_summary(t):
    """AGG-29: rows, UCs, violations and value by scenario and region."""
    return _round(C.compensation_summary(comp(t), ("cenario", "regional")), 2, "valor_estimado")


@query("compensation_top", B.with_(*B.MONEY) + """
SELECT uc, cenario, round(valor, 4) AS valor FROM comp WHERE viola ORDER BY valor DESC NULLS LAST, uc, cenario, regional, conjunto_aneel LIMIT 100""")
def compensation_top(t):
    """SRT-03, Q21: violations only, by value."""
    from ..operators.relational import paged
    page = paged(comp(t), [*C.compensation_order(comp(t)), F.asc("regional"), F.asc("conjunto_aneel")], 100, where=F.col("possui_violacao"))
    return page.select("uc", "cenario", F.round("valor_ressarcimento_estimado", 4).alias("valor"))


# ------------------------------------------------------------------------------------------ audits

AUDIT = B.with_(*B.TREATED, B.BASE, B.BILLED)
_T = ["coalesce(m >= 0, false)", "coalesce(m >= 3, false)", "coalesce(estado = '4', false)", "coalesce(trim(protocolo) = '0', false)", B.BLANK("motivo")]
_STEP = [" AND ".join(_T[: i + 1]) for i in range(5)]


@query("audit_filter_funnel", AUDIT + f"""
SELECT cenario, count(*) AS total_linhas, count(DISTINCT num_uc_uci) AS ucs_total, count(*) FILTER ({_STEP[0]}) AS linhas_datas_validas,
       count(*) FILTER ({_STEP[1]}) AS linhas_duracao_3min, count(*) FILTER ({_STEP[2]}) AS linhas_estado_4,
       count(*) FILTER ({_STEP[3]}) AS linhas_protocolo_0, count(*) FILTER ({_STEP[4]}) AS linhas_motivo_nulo,
       count(DISTINCT CASE WHEN {_STEP[4]} THEN num_uc_uci END) AS ucs_liquidas FROM base GROUP BY 1""")
def audit_filter_funnel(t):
    """AUD-01."""
    return A.filter_funnel(base(t))


def _billed_ids(t):
    return I.billed_ucs(B.billed(t))


@query("audit_billed_effect", AUDIT + f"""
SELECT cenario, count(*) AS linhas_liquidas_faturadas, count(DISTINCT num_uc_uci) AS ucs_liquidas_faturadas, round(sum(m) / 60.0, 4) AS soma_dic_horas,
       count(DISTINCT num_seq_intrp) AS soma_fic FROM base WHERE {_STEP[4]} AND num_uc_uci IN (SELECT uc FROM billed) GROUP BY 1""")
def audit_billed_effect(t):
    """AUD-02."""
    return _round(A.billed_effect(base(t), _billed_ids(t)), 4, "soma_dic_horas")


@query("audit_two_denominators", B.with_(*B.TREATED, B.BASE, B.BILLED, B.OFFICIAL, f"""num AS (
  SELECT cenario, regional_origem, num_uc_uci, sum(m) / 60.0 AS dic, count(DISTINCT num_seq_intrp) AS fic FROM base
  WHERE {_STEP[4]} AND num_uc_uci IN (SELECT uc FROM billed) GROUP BY 1, 2, 3),
reg AS (SELECT cenario, regional_origem, count(*) AS d, sum(dic) AS sd, CAST(sum(fic) AS BIGINT) AS sf FROM num GROUP BY 1, 2),
todos AS (SELECT * FROM reg UNION ALL SELECT cenario, 'COPEL', CAST(sum(d) AS BIGINT), sum(sd), CAST(sum(sf) AS BIGINT) FROM reg GROUP BY 1),
iqs AS (SELECT regional AS r, qtd AS q FROM official WHERE regional <> 'COPEL' UNION ALL SELECT 'COPEL', sum(qtd) FROM official WHERE regional <> 'COPEL')""") + """
SELECT cenario, regional_origem, round(sd, 4) AS soma_dic_horas, sf AS soma_fic, d AS denominador_oms, q AS denominador_iqs,
       round(sd / nullif(d, 0), 6) AS dec_com_den_oms, round(sd / nullif(q, 0), 6) AS dec_com_den_iqs FROM todos LEFT JOIN iqs ON r = regional_origem""")
def audit_two_denominators(t):
    """AUD-03, JN-24."""
    off = B.official(t).select(F.col("REGIONAL_TOTAL").alias("regional_origem"), F.col("UC_faturada").alias("quantidade_ucs_iqs"))
    rows = _round(A.two_denominators(base(t), _billed_ids(t), off), 6, "dec_com_den_oms", "dec_com_den_iqs")
    return _round(rows, 4, "soma_dic_horas").drop("fec_com_den_oms", "fec_com_den_iqs")


MONEY = B.with_(*B.MONEY)


@query("audit_totals", MONEY + """
SELECT cenario, count(*) AS linhas, count(DISTINCT uc) AS ucs, count(*) FILTER (viola) AS linhas_com_violacao, round(sum(c1), 2) AS soma_comp_dic,
       round(sum(c2), 2) AS soma_comp_fic, round(sum(c3), 2) AS soma_comp_dmic, round(sum(valor), 2) AS valor_total FROM comp GROUP BY 1""")
def audit_totals(t):
    """AUD-04."""
    return _round(A.compensation_totals(comp(t)), 2, "soma_comp_dic", "soma_comp_fic", "soma_comp_dmic", "valor_total")


@query("audit_winner", MONEY + """
SELECT cenario, CASE WHEN valor = 0 THEN 'SEM_VIOLACAO' WHEN c1 >= c2 AND c1 >= c3 THEN 'DIC' WHEN c2 >= c1 AND c2 >= c3 THEN 'FIC' ELSE 'DMIC' END AS indicador_vencedor,
       count(*) AS linhas, count(DISTINCT uc) AS ucs, round(sum(valor), 2) AS valor_total, round(avg(valor), 4) AS valor_medio, round(max(valor), 4) AS maior_valor
FROM comp GROUP BY 1, 2""")
def audit_winner(t):
    """AUD-05."""
    return _round(_round(A.winning_indicator(comp(t)), 2, "valor_total"), 4, "valor_medio", "maior_valor")


@query("audit_voltage", MONEY + """
SELECT cenario, coalesce(grupo_tensao, 'SEM_GRUPO') AS grupo_tensao, coalesce(nivel_tensao, 'SEM_NIVEL') AS nivel_tensao, kei, count(*) AS linhas,
       count(DISTINCT uc) AS ucs, round(sum(valor), 2) AS valor_total, round(avg(vrc), 4) AS vrc_medio, round(max(vrc), 2) AS vrc_maximo
FROM comp WHERE valor > 0 GROUP BY 1, 2, 3, 4""")
def audit_voltage(t):
    """AUD-06."""
    return _round(_round(A.value_by_voltage(comp(t)), 2, "valor_total", "vrc_maximo"), 4, "vrc_medio")


@query("audit_duplicates", MONEY + """
SELECT cenario, count(*) AS ucs_duplicadas, CAST(sum(q) AS BIGINT) AS linhas_duplicadas, round(sum(v), 2) AS valor_em_duplicidade FROM (
  SELECT cenario, uc, count(*) AS q, sum(valor) AS v FROM comp GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def audit_duplicates(t):
    """AUD-07."""
    return _round(A.duplicate_summary(comp(t)), 2, "valor_em_duplicidade")


@query("audit_duplicate_detail", MONEY + """
SELECT cenario, uc, regional, conjunto_aneel, round(valor, 4) AS valor FROM comp
WHERE (cenario, uc) IN (SELECT (cenario, uc) FROM comp GROUP BY cenario, uc HAVING count(*) > 1)""")
def audit_duplicate_detail(t):
    """AUD-07, JN-23."""
    return A.duplicate_detail(comp(t)).select("cenario", "uc", "regional", "conjunto_aneel", F.round("valor_ressarcimento_estimado", 4).alias("valor"))


@query("audit_vrc_quantiles", MONEY + """
SELECT cenario, count(*) AS linhas, count(DISTINCT uc) AS ucs, round(min(vrc), 2) AS vrc_min, round(avg(vrc), 4) AS vrc_avg, round(max(vrc), 2) AS vrc_max,
       round(quantile_cont(vrc, 0.5), 4) AS vrc_p50, round(quantile_cont(vrc, 0.9), 4) AS vrc_p90, round(quantile_cont(vrc, 0.99), 4) AS vrc_p99
FROM comp GROUP BY 1""")
def audit_vrc_quantiles(t):
    """AUD-08: exact interpolated quantiles."""
    rows = _round(A.vrc_distribution(comp(t)), 4, "vrc_avg", "vrc_p50", "vrc_p90", "vrc_p99")
    return _round(rows, 2, "vrc_min", "vrc_max")


@query("audit_target_gaps", MONEY + """
SELECT cenario, count(*) FILTER (l_dic IS NULL) AS meta_dic_nula, count(*) FILTER (l_fic IS NULL) AS meta_fic_nula, count(*) FILTER (l_dmic IS NULL) AS meta_dmic_nula,
       count(*) FILTER (l_dic = 0) AS meta_dic_zero, count(*) FILTER (l_fic = 0) AS meta_fic_zero, count(*) FILTER (l_dmic = 0) AS meta_dmic_zero,
       round(sum(valor), 2) AS valor_total FROM comp GROUP BY 1""")
def audit_target_gaps(t):
    """AUD-09."""
    return _round(A.target_gaps(comp(t)), 2, "valor_total")


def _pay(done, limit, amount):
    return f"CASE WHEN {done} > {limit} THEN vrc * ({amount}) * kei ELSE 0 END"


_TOT = "greatest(" + ", ".join(_pay(d, m, f"{d} / 730.0") for d, m in (("dic_horas", "l_dic"), ("fic", "l_fic"), ("dmic_horas", "l_dmic"))) + ")"
_EXC = "greatest(" + ", ".join(_pay(d, m, f"({d} - {m}) / 730.0") for d, m in (("dic_horas", "l_dic"), ("fic", "l_fic"), ("dmic_horas", "l_dmic"))) + ")"
_EXP = ("greatest(" + _pay("dic_horas", "l_dic", "(dic_horas - l_dic) / 730.0") + ", " + _pay("fic", "l_fic", "fic - l_fic") + ", "
        + _pay("dmic_horas", "l_dmic", "(dmic_horas - l_dmic) / 730.0") + ")")


@query("audit_formulas", MONEY + f"""
SELECT cenario, round(sum({_TOT}), 2) AS total_formula_atual, round(sum({_EXC}), 2) AS total_formula_excedente,
       round(sum({_TOT}) - sum({_EXC}), 2) AS diferenca, count(DISTINCT CASE WHEN {_TOT} > 0 THEN uc END) AS ucs_compensadas_atual,
       count(DISTINCT CASE WHEN {_EXC} > 0 THEN uc END) AS ucs_compensadas_excedente FROM comp0 GROUP BY 1""")
def audit_formulas(t):
    """AUD-10."""
    return _round(A.formula_comparison(comp(t)), 2, "total_formula_atual", "total_formula_excedente", "diferenca")


@query("audit_fic_alternatives", MONEY + f"""
SELECT cenario, round(sum({_EXC}), 2) AS total_excedente_fic_div730, round(sum({_EXP}), 2) AS total_excedente_fic_sem_div730 FROM comp0 GROUP BY 1""")
def audit_fic_alternatives(t):
    """AUD-11."""
    return _round(A.fic_alternatives(comp(t)), 2, "total_excedente_fic_div730", "total_excedente_fic_sem_div730")


@query("audit_negative_health", B.with_(B.RAW) + f"""
SELECT count(*) AS registros_negativos, count(DISTINCT NUM_SEQ_INTRP) AS interrupcoes_negativas FROM raw
WHERE {B._parse('DATA_HORA_FIM_INTRP')} < {B._parse('DATA_HORA_INIC_INTRP')}""")
def audit_negative_health(t):
    """AUD-12."""
    return A.negative_health(B.raw(t))


@query("record_classes", B.with_(B.RAW, B.UNI) + """
SELECT CASE WHEN duracao >= 3 THEN 'Longa' ELSE 'Curta' END AS tipo, count(*) AS linhas FROM uni GROUP BY 1""")
def record_classes(t):
    """PRJ-23: long and short rows."""
    return B.uni(t).groupBy(X.long_or_short("duracao").alias("tipo")).agg(F.count("*").alias("linhas"))
