"""Reference marts, targets, history and consistency."""

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.time import iso_text, parse_ts
from ..plans import compensation as C
from ..plans import indicators as I
from ..plans import marts
from ..plans import reference as R
from . import relations as B
from .quality_queries import FMT
from .registry import query

_REG = "CASE r_regionkey WHEN 0 THEN 'CSL' WHEN 1 THEN 'LES' WHEN 2 THEN 'NRO' WHEN 3 THEN 'NRT' ELSE {} END"


def _region_code(default: str):
    out = F.lit(default)
    for k, v in {0: "CSL", 1: "LES", 2: "NRO", 3: "NRT"}.items():
        out = F.when(F.col("r_regionkey") == k, F.lit(v)).otherwise(out)
    return out


def _customer_region(t, default: str = "SCD"):
    """Snowflake customer, nation, region (JN-19)."""
    sections = t.nation.withColumnsRenamed({"n_nationkey": "cod_seccional", "n_regionkey": "cod_regional"})
    regions = t.region.withColumn("cod_regional", F.col("r_regionkey"))
    # The given tables have two levels; a locality is a customer's nation, which is its own section.
    localities = t.nation.select(F.col("n_nationkey").alias("cod_local"), F.col("n_nationkey").alias("cod_seccional"))
    customers = t.customer.withColumn("cod_local", F.col("c_nationkey"))
    return R.with_region(customers, localities, sections, regions).withColumn("regional", _region_code(default))


_CUST = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("consumers_by_region", f"""
SELECT CASE WHEN grouping(reg) = 1 THEN 'COPEL' ELSE reg END AS "REGIONAL_TOTAL", count(*) AS "UC", count(*) FILTER (loc = 'U') AS "UC_URBANA",
       count(*) FILTER (loc = 'R') AS "UC_RURAL", round(sum(v), 2) AS "VRC", round(sum(CASE WHEN loc = 'U' THEN v ELSE 0 END), 2) AS "VRC_URBANO"
FROM (SELECT {_REG.format("'OES'")} AS reg, CASE c_mktsegment WHEN 'BUILDING' THEN 'U' WHEN 'MACHINERY' THEN 'U' ELSE 'R' END AS loc,
             CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS v FROM {_CUST} WHERE c_mktsegment <> 'HOUSEHOLD')
GROUP BY ROLLUP (reg)""")
def consumers_by_region(t):
    """PIP-25, AGG-18, JN-19: UCs, urban, rural and values by region with total."""
    rows = _customer_region(t, "OES").select(
        "regional", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("U")).otherwise(F.lit("R")).alias("local"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("XX")).otherwise(F.lit("LG")).alias("situacao"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("vrc"))
    out = R.consumers_by_region(rows)
    return out.withColumns({c: F.round(c, 2) for c in ("VRC", "VRC_URBANO")}).drop("VRC_RURAL")


@query("billed_by_region", f"""
SELECT CASE WHEN grouping(reg) = 1 THEN 'COPEL' ELSE reg END AS "REGIONAL_TOTAL",
       CASE reg WHEN 'CSL' THEN 'P' WHEN 'NRT' THEN 'L' WHEN 'NRO' THEN 'M' WHEN 'LES' THEN 'C' WHEN 'OES' THEN 'V' ELSE 'COPEL' END AS "SIGLA_REGIONAL",
       CASE reg WHEN 'CSL' THEN 'SODPGO' WHEN 'NRT' THEN 'SODLNA' WHEN 'NRO' THEN 'SODMGA' WHEN 'LES' THEN 'SODCTA' WHEN 'OES' THEN 'SDOCEL' ELSE 'COPEL' END AS "SIGLA_SEVIDOR",
       anomes, CAST(sum(n) AS BIGINT) AS "UC_faturada"
FROM (SELECT {_REG.format("'SCD'")} AS reg, strftime(o_orderdate, '%Y-%m') AS anomes, count(*) AS n
      FROM orders JOIN {_CUST} ON o_custkey = c_custkey GROUP BY 1, 2) WHERE reg <> 'SCD' GROUP BY GROUPING SETS ((reg, anomes), (anomes))""".replace(
    f"orders JOIN {_CUST} ON o_custkey = c_custkey", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def billed_by_region(t):
    """PIP-25, AGG-19/21: billed UCs by region and month with total and code maps."""
    rows = t.orders.join(_customer_region(t), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "regional", F.date_format("o_orderdate", "yyyy-MM").alias("anomes")).agg(
        F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("urbano"), F.sum((F.col("o_orderstatus") != "O").cast("long")).alias("rural"))
    return R.billed_by_region(rows)


_LIMITS = """lim AS (
  SELECT 'K' || (s_suppkey % 12) AS cea, 2024 AS ano_ref, CAST(max(CASE WHEN mes = 12 THEN q END) AS DOUBLE) AS limite_dec,
         CAST(max(CASE WHEN mes = 12 THEN q + 1 END) AS DOUBLE) AS limite_fec
  FROM supplier JOIN (SELECT l_suppkey, month(l_shipdate) AS mes, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) ON l_suppkey = s_suppkey
  GROUP BY 1, 2)"""


def _limits(t):
    kinds = F.explode(F.array(F.lit(S.TARGET_INDICATOR_DEC), F.lit(S.TARGET_INDICATOR_FEC)))
    num = (F.col("s_suppkey") * 100 + F.col("tipo_indicador")).alias("num_meta")
    heads = t.supplier.withColumn("tipo_indicador", kinds).select(
        num, F.concat(F.lit("K"), (F.col("s_suppkey") % 12).cast("string")).alias("cea"), "tipo_indicador", F.lit(2024).alias("ano_ref"))
    values = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey"), F.month("l_shipdate").alias("mes")).agg(F.max("l_quantity").alias("q"))
    amount = F.col("q") + F.when(F.col("tipo_indicador") == S.TARGET_INDICATOR_FEC, F.lit(1)).otherwise(F.lit(0))
    values = values.withColumn("tipo_indicador", kinds).select(num, "mes", F.replace(amount.cast("string"), F.lit("."), F.lit(",")).alias("valor"))
    return C.set_limits(heads, values)


@query("set_limits", B.with_(_LIMITS) + "SELECT * FROM lim")
def set_limits(t):
    """AGG-22: limits per set and year from the December values."""
    return _limits(t)


def _ladder(steps, limit):
    text = "".join(f" WHEN {limit} <= {u} THEN {v}" for u, v in steps if u is not None)
    last = steps[-1][1]
    return f"CASE{text} ELSE {last} END" if text else str(last)


def _band_sql(name):
    limit, bands = S.TARGET_BANDS[name]
    cases = []
    for (klass, mark), steps in bands.items():
        group, levels = S.VOLTAGE_CLASSES[klass]
        test = f"grupo = '{group}' AND ur = '{mark}'" + (f" AND nivel IN ({', '.join(repr(x) for x in levels)})" if levels else "")
        cases.append(f"WHEN {test} THEN {_ladder(steps, limit)}")
    return f"CAST(CASE {' '.join(cases)} END AS DOUBLE) AS \"{name}\""


_UCS = """ucs AS (
  SELECT p_partkey, 'K' || (p_partkey % 12) AS cea, CASE WHEN p_size % 2 = 0 THEN 'U' ELSE 'R' END AS ur,
         CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END AS grupo,
         CASE p_size % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3a' WHEN 3 THEN '4' ELSE 'S' END AS nivel
  FROM part WHERE p_size <> 7)"""


def _ucs(t):
    s = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("ISN_UC"), F.concat(F.lit("K"), (F.col("p_partkey") % 12).cast("string")).alias("cea"),
        F.when(s % 2 == 0, F.lit("U")).otherwise(F.lit("R")).alias("urb_rur"), F.when(s % 3 == 0, F.lit("A")).otherwise(F.lit("B")).alias("grupo"),
        F.element_at(F.array(*[F.lit(x) for x in ("1", "2", "3a", "4", "S")]), s % 5 + 1).alias("nivel"),
        F.when(s == 7, F.lit("DS")).when(s % 7 == 1, F.lit("CR")).otherwise(F.lit("LG")).alias("situacao"),
        F.when(s % 6 != 0, F.col("p_retailprice")).alias("vrc"))


@query("uc_targets", B.with_(_LIMITS, _UCS) + f"""
SELECT p_partkey AS "ISN_UC", cea AS "COD_CONJUNTO_ANEEL", ur AS urb_rur, grupo AS "COD_GRUPO_NTFN", nivel AS "COD_NTFN", limite_dec AS "META_DEC",
       limite_fec AS "META_FEC", {_band_sql('META_DIC')}, {_band_sql('META_FIC')}, {_band_sql('META_DMIC')},
       CAST(CASE WHEN grupo = 'A' AND nivel IN ('4','5') AND ur = 'U' THEN 8 WHEN grupo = 'A' AND nivel IN ('4','5') THEN 21 WHEN grupo = 'B' AND ur = 'U' THEN 13
            WHEN grupo = 'B' THEN 21 WHEN nivel IN ('1','2','3') THEN 0.001 END AS DOUBLE) AS "META_DICRI",
       CAST(CASE WHEN grupo = 'A' AND nivel IN ('4','5') AND ur = 'U' THEN 24 WHEN grupo = 'A' AND nivel IN ('4','5') THEN 48 WHEN grupo = 'B' AND ur = 'U' THEN 24
            WHEN grupo = 'B' THEN 48 WHEN nivel IN ('1','2','3') THEN 0.001 END AS DOUBLE) AS "META_DISE"
FROM ucs JOIN lim USING (cea)""")
def uc_targets(t):
    """PIP-24, PRJ-21, JN-20: targets per UC from class, urban/rural mark and band of the set's limits."""
    ucs = _ucs(t)
    volts = ucs.select("grupo", "nivel").distinct().withColumn("descricao", F.concat_ws(" ", "grupo", "nivel"))
    return C.uc_targets(ucs, _limits(t), volts, 2024).drop("ano_ref", "DESC_NTFN")


@query("vrc_extract", B.with_(_UCS) + """
SELECT p_partkey AS "ISN_UC", ucs.cea, ur AS urb_rur, grupo AS "COD_GRUPO_NIVEL_TENSAO_UC", nivel AS "COD_NIVEL_TENSAO_UC",
       round(CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_retailprice END, 2) AS "VRC" FROM ucs JOIN part USING (p_partkey)""")
def vrc_extract(t):
    """SRC-19: reference value of active UCs."""
    return R.vrc_extract(_ucs(t)).withColumn("VRC", F.round("VRC", 2))


@query("billed_uc_extract", """
SELECT DISTINCT o_custkey AS uc, CASE WHEN l_returnflag = 'N' THEN 'S' ELSE 'N' END AS faturado,
       CASE l_suppkey % 6 WHEN 0 THEN 'CSL' WHEN 1 THEN 'NRT' WHEN 2 THEN 'NRO' WHEN 3 THEN 'LES' WHEN 4 THEN 'OES' ELSE 'COPEL' END AS regional
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y%m') = '199705' AND l_linestatus = 'O'""")
def billed_uc_extract(t):
    """SRC-18: distinct UCs of a month with billing flag and region."""
    letters = F.array(*[F.lit(x) for x in ("P", "L", "M", "C", "V", "?")])
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("uc"), F.when(F.col("l_returnflag") == "N", F.lit("S")).otherwise(F.lit("N")).alias("faturado"),
        F.element_at(letters, (F.col("l_suppkey") % 6 + 1).cast("int")).alias("letra"),
        F.when(F.col("l_linestatus") == "O", F.lit("N")).otherwise(F.lit("S")).alias("acessante"), F.col("o_orderdate").alias("dt_ini"))
    return R.billed_uc_extract(rows, "199705")


@query("marts_summary", """
SELECT 'pedidos' AS fonte, count(*) AS linhas_raw, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS linhas_mart, 'processado' AS status FROM orders
UNION ALL SELECT 'itens', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)), 'processado' FROM lineitem
UNION ALL SELECT 'ausente', 0, 0, 'pendente_raw'""")
def marts_summary(t):
    """PIP-21, AGG-32, SRC-16: distinct marts with status."""
    return R.marts_summary(t.spark, {
        "pedidos": t.orders.select("o_custkey", "o_orderstatus"), "itens": t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"), "ausente": None})


@query("distinct_extract", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS L_PARTKEY, CAST(l_returnflag AS VARCHAR) AS L_RETURNFLAG FROM lineitem".replace(
    "AS L_PARTKEY", 'AS "L_PARTKEY"').replace("AS L_RETURNFLAG", 'AS "L_RETURNFLAG"'))
def distinct_extract(t):
    """SNK-13, SRC-10: all text under upper-case names, distinct."""
    return R.distinct_mart(R.as_text(t.lineitem.select("l_partkey", "l_returnflag")))


_HISTEV = f"""hev AS (
  SELECT CAST(NUM_SEQ_INTRP AS BIGINT) AS interrupcao, NUM_OPER_CHV_INTRP AS device, min({B.INI}) AS inicio, max({B.FIM}) AS fim
  FROM uni WHERE TIPO_EQP_INTRP = 'C' AND trim(NUM_OPER_CHV_INTRP) <> '' AND {B.INI} IS NOT NULL AND {B.FIM} IS NOT NULL
    AND strftime({B.INI}, '%Y%m') = '202402' GROUP BY 1, 2),
haf AS (SELECT CAST(NUM_SEQ_INTRP AS BIGINT) AS interrupcao, TIPO_PROTOC_JUSTIF_UCI AS p, count(NUM_UC_UCI) AS n FROM uni GROUP BY 1, 2)"""


@query("device_containment_history", B.with_(B.RAW, B.UNI, _HISTEV) + f"""
SELECT a.device AS "NUMERO_OPERACIONAL", a.interrupcao, strftime(inicio, {FMT}) AS "DATA_INICIO", p AS tipo_protocolo_hcai, n AS "UC_afetadas",
       CASE WHEN EXISTS (SELECT 1 FROM hev b WHERE a.device = b.device AND a.interrupcao <> b.interrupcao AND b.inicio <= a.inicio AND b.fim >= a.fim
         AND (b.inicio < a.inicio OR b.fim > a.fim OR b.interrupcao < a.interrupcao)) THEN 'EXCLUIR (Contido em outra)' ELSE 'MANTER (OK)' END AS "SITUACAO"
FROM hev a JOIN haf ON haf.interrupcao = a.interrupcao""")
def device_containment_history(t):
    """PIP-26, JN-22: month analysis from event history with affected UCs per protocol."""
    rows = B.uni(t)
    events = rows.where(F.col(B.INI).isNotNull() & F.col(B.FIM).isNotNull() & (F.trim("NUM_OPER_CHV_INTRP") != "")).groupBy(
        F.col("NUM_SEQ_INTRP").cast("long").alias("interrupcao"), F.col("NUM_OPER_CHV_INTRP").alias("device")).agg(
        F.min(B.INI).alias("inicio"), F.max(B.FIM).alias("fim"), F.max("TIPO_EQP_INTRP").alias("tipo_eqp"), F.max("NUM_OCORRENCIA_ADMS").alias("ocorrencia"),
        F.max("TIPO_CHV_INTRP").alias("tipo_chave"), F.max("COD_CAUSA_INTRP").alias("causa"), F.max("COD_COMP_INTRP").alias("comp"),
        F.max("COD_TIPO_INTRP").alias("tipo"), F.max("TIPO_PROTOC_JUSTIF_INTRP").alias("protocolo"))
    affected = rows.select(F.col("NUM_SEQ_INTRP").cast("long").alias("interrupcao"), F.col("TIPO_PROTOC_JUSTIF_UCI").alias("protocolo_uc"), F.col("NUM_UC_UCI").alias("uc"))
    return R.device_containment_history(events, affected, "202402").select(
        "NUMERO_OPERACIONAL", "interrupcao", iso_text("DATA_INICIO").alias("DATA_INICIO"), "tipo_protocolo_hcai", "UC_afetadas", "SITUACAO")


def history(t):
    """The historic table rebuilt from raw rows: the layout mapping read backwards."""
    rows = B.raw(t)
    columns = {}
    for name, source in S.HISTORY_LAYOUT.items():
        if source is not None and source not in columns:
            columns[source] = F.col(name)
    columns[S.HISTORY_LAYOUT["DATA_HORA_INIC_INTRP"]] = parse_ts("DATA_HORA_INIC_INTRP")
    columns[S.HISTORY_LAYOUT["DATA_HORA_FIM_INTRP"]] = parse_ts("DATA_HORA_FIM_INTRP")
    late = F.col("arquivo_csv") == "b.csv"
    columns[S.HISTORY_LOADED_AT] = F.when(late, F.lit("2024-04-02")).otherwise(F.lit("2024-04-01"))
    columns[S.HISTORY_FILE] = F.concat(F.lit("h_"), F.coalesce("REGIONAL_ORIGEM", F.lit("x")), F.lit(".CSV"))
    return rows.select(*[c.alias(n) for n, c in columns.items()])


_HIST = f"""hist AS (
  SELECT NUM_SEQ_INTRP AS seq, PID_POSTO_PIN AS posto, NUM_UC_UCI AS uc, ESTADO_INTRP, TIPO_EQP_INTRP, NUM_OPER_CHV_INTRP AS device, COD_CAUSA_INTRP, COD_COMP_INTRP,
         {B._parse('DATA_HORA_INIC_INTRP')} AS inicio, {B._parse('DATA_HORA_FIM_INTRP')} AS fim, arquivo_csv, coalesce(REGIONAL_ORIGEM, 'x') AS arq,
         upper(trim(SIGLA_REGIONAL)) AS sig FROM raw),
hd AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY seq, posto, uc ORDER BY arquivo_csv DESC, arq DESC) AS rn FROM hist
    WHERE inicio >= TIMESTAMP '2024-02-01' AND inicio < TIMESTAMP '2024-03-01' AND fim >= TIMESTAMP '2024-02-01' AND fim < TIMESTAMP '2024-03-01')
  WHERE rn = 1 AND fim >= inicio AND nullif(trim(COD_CAUSA_INTRP), '') IS NOT NULL AND nullif(trim(COD_COMP_INTRP), '') IS NOT NULL),
he AS (SELECT DISTINCT seq, device, inicio, fim FROM hd WHERE ESTADO_INTRP = '4' AND TIPO_EQP_INTRP = 'C' AND trim(device) <> ''),
hx AS (SELECT DISTINCT a.seq FROM he a JOIN he b ON a.device = b.device AND a.seq <> b.seq AND b.inicio <= a.inicio AND b.fim >= a.fim
  AND (b.inicio < a.inicio OR b.fim > a.fim OR CAST(b.seq AS BIGINT) < CAST(a.seq AS BIGINT)))"""


@query("treated_from_history", B.with_(B.RAW, _HIST) + f"""
SELECT seq AS "NUM_SEQ_INTRP", posto AS "NUM_POSTO_UCI", uc AS "NUM_UC_UCI", strftime(inicio, {FMT}) AS inicio, strftime(fim, {FMT}) AS fim,
       CASE WHEN sig IN ('CSL','LES','NRO','NRT','OES') THEN sig WHEN arq <> 'x' THEN arq ELSE 'SEM_REGIONAL' END AS "REGIONAL_ORIGEM",
       round(date_diff('second', inicio, fim) / 60.0, 6) AS duracao_minutos FROM hd WHERE seq NOT IN (SELECT seq FROM hx)""")
def treated_from_history(t):
    """PIP-22, PRJ-17, WIN-08, JN-05/09: treated rows straight from the historic table."""
    return marts.treated_from_history(history(t), "202402").select(
        "NUM_SEQ_INTRP", "NUM_POSTO_UCI", "NUM_UC_UCI", iso_text("DATA_HORA_INIC_INTRP").alias("inicio"), iso_text("DATA_HORA_FIM_INTRP").alias("fim"),
        "REGIONAL_ORIGEM", "duracao_minutos")


_CONS = f"""ucr AS (SELECT CAST(p_partkey AS VARCHAR) AS num_uc, CASE p_size % 7 WHEN 0 THEN 'CSL' WHEN 1 THEN 'LES' WHEN 2 THEN 'NRO' WHEN 3 THEN 'NRT'
                 WHEN 4 THEN 'OES' WHEN 5 THEN 'SCD' END AS regional FROM part),
evt AS (SELECT NUM_SEQ_INTRP AS num_evento, max({B.FIM}) AS dt_fim, max(TIPO_PROTOC_JUSTIF_INTRP) AS pe FROM uni GROUP BY 1),
aff AS (SELECT NUM_UC_UCI AS num_uc, coalesce(NUM_POSTO_UCI, '-') AS num_posto, NUM_SEQ_INTRP AS num_evento, NUM_INTRP_INIC_MANOBRA_UCI AS man, {B.INI_UC} AS dt_ini,
         nullif(trim(TIPO_PROTOC_JUSTIF_UCI), '') AS prot, NUM_MOTIVO_TRAT_DIF_UCI AS motivo, CASE WHEN length(COD_CAUSA_INTRP) = 1 AND COD_CAUSA_INTRP < '4' THEN 'S' ELSE 'N' END AS fat
  FROM uni WHERE strftime({B.INI_UC}, '%Y%m') = '202402'),
cb AS (
  SELECT regional AS o, a.num_uc, num_posto, dt_ini, dt_fim, coalesce(nullif(trim(man), ''), a.num_evento) AS k,
         CASE WHEN trim(motivo) IS NOT NULL AND trim(motivo) NOT IN ('', '0') THEN 'Ignorar' WHEN coalesce(prot, pe, '0') = '0' THEN 'Liquido' ELSE 'Expurgo' END AS c
  FROM aff a JOIN ucr u ON u.num_uc = a.num_uc AND regional <> 'SCD' LEFT JOIN evt e ON e.num_evento = a.num_evento
  WHERE a.num_uc IN (SELECT num_uc FROM aff WHERE fat = 'S')),
cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, num_posto, num_uc ORDER BY dt_fim DESC NULLS LAST, dt_ini NULLS LAST, c, o) AS rn FROM cb WHERE c <> 'Ignorar')
  WHERE rn = 1 AND dt_fim >= dt_ini),
cm AS (SELECT *, CASE WHEN dt_ini <= max(dt_fim) OVER (PARTITION BY o, num_uc ORDER BY dt_ini, dt_fim, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS novo FROM cd),
cp AS (SELECT *, sum(novo) OVER (PARTITION BY o, num_uc ORDER BY dt_ini, dt_fim, k ROWS UNBOUNDED PRECEDING) AS p FROM cm),
cu AS (SELECT o, num_uc, c, p, date_diff('second', min(dt_ini), max(dt_fim)) AS s FROM cp GROUP BY 1, 2, 3, 4),
ca AS (SELECT o, c, count(*) AS ci, sum(s) / 3600.0 AS chi, count(*) FILTER (s >= 180) AS ci_longa, coalesce(sum(s) FILTER (s >= 180), 0) / 3600.0 AS chi_longa FROM cu GROUP BY 1, 2),
off AS (SELECT regional, qtd FROM official WHERE regional <> 'COPEL'),
cr AS (
  SELECT o, c, ci, chi, ci_longa, chi_longa, (SELECT max(qtd) FROM off WHERE regional = o) AS q FROM ca
  UNION ALL SELECT o, 'Bruto', CAST(sum(ci) AS BIGINT), sum(chi), CAST(sum(ci_longa) AS BIGINT), sum(chi_longa), (SELECT max(qtd) FROM off WHERE regional = o) FROM ca GROUP BY 1
  UNION ALL SELECT 'COPEL', c, CAST(sum(ci) AS BIGINT), sum(chi), CAST(sum(ci_longa) AS BIGINT), sum(chi_longa), (SELECT sum(qtd) FROM off) FROM ca GROUP BY 2
  UNION ALL SELECT 'COPEL', 'Bruto', CAST(sum(ci) AS BIGINT), sum(chi), CAST(sum(ci_longa) AS BIGINT), sum(chi_longa), (SELECT sum(qtd) FROM off) FROM ca)"""


@query("consistency_by_region", B.with_(B.RAW, B.UNI, B.OFFICIAL, _CONS) + """
SELECT o AS arquivo_origem, c AS classificacao, ci, round(chi, 4) AS chi, ci_longa, round(chi_longa, 4) AS chi_longa_s, q AS mercado_faturado,
       CASE WHEN q > 0 THEN round(ci_longa / q, 8) ELSE 0 END AS fec, CASE WHEN q > 0 THEN round(chi_longa / q, 8) ELSE 0 END AS dec FROM cr""")
def consistency_by_region(t):
    """PIP-23, AGG-20/21, WIN-08/09, Q12: CI, CHI, FEC, DEC by region and class, gross and company rows."""
    rows = B.uni(t)
    size = F.col("p_size") % 7
    region = F.lit(None).cast("string")
    for k, v in enumerate(["CSL", "LES", "NRO", "NRT", "OES", "SCD"]):
        region = F.when(size == k, F.lit(v)).otherwise(region)
    cause = F.col("COD_CAUSA_INTRP")
    affected = rows.select(
        F.col("NUM_UC_UCI").alias("num_uc"), F.coalesce("NUM_POSTO_UCI", F.lit("-")).alias("num_posto"), F.col("NUM_SEQ_INTRP").alias("num_evento"),
        F.col("NUM_INTRP_INIC_MANOBRA_UCI").alias("num_manobra"), F.col(B.INI_UC).alias("dt_ini"),
        F.nullif(F.trim("TIPO_PROTOC_JUSTIF_UCI"), F.lit("")).alias("protocolo"), F.col("NUM_MOTIVO_TRAT_DIF_UCI").alias("motivo"),
        F.when((F.length(cause) == 1) & (cause < "4"), F.lit("S")).otherwise(F.lit("N")).alias("faturado"))
    events = rows.groupBy(F.col("NUM_SEQ_INTRP").alias("num_evento")).agg(
        F.max(B.FIM).alias("dt_fim"), F.max("TIPO_PROTOC_JUSTIF_INTRP").alias("protocolo_evento"))
    off = B.official(t).where("REGIONAL_TOTAL <> 'COPEL'").select(F.col("REGIONAL_TOTAL").alias("regional"), F.col("UC_faturada").alias("uc_faturada"))
    out = I.consistency_by_region(affected, events, t.part.select(F.col("p_partkey").cast("string").alias("num_uc"), region.alias("regional")), off, "202402")
    return out.withColumns({"chi": F.round("chi", 4), "chi_longa_s": F.round("chi_longa_s", 4), "fec": F.round("fec", 8), "dec": F.round("dec", 8)}).drop("yyyymm")
