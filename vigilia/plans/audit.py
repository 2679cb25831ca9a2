"""Reconciliation queries over the indicator and compensation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.time import parse_ts
from ..operators.relational import exact_quantiles, stack
from .indicators import net_terms

AUDIT_TERMS = ["datas_validas", "duracao_3min", "estado_4", "protocolo_0", "motivo_nulo"]


def _audit_rule():
    terms = net_terms()
    return reduce(lambda a, b: a & b, [terms[t] for t in AUDIT_TERMS])


def filter_funnel(base: DataFrame) -> DataFrame:
    """Rows left after each criterion, and UCs before and after all of them, per scenario.

    Rows are counted per UC first, so the distinct counts are sums.
    """
    terms = net_terms()
    steps, so_far = {}, None
    for name in AUDIT_TERMS:
        so_far = terms[name] if so_far is None else so_far & terms[name]
        steps[f"linhas_{name}"] = so_far
    per_uc = base.groupBy("cenario", "num_uc_uci").agg(
        F.count("*").alias("total_linhas"), *[F.sum(c.cast("long")).alias(n) for n, c in steps.items()]
    )
    last = list(steps)[-1]
    return per_uc.groupBy("cenario").agg(
        F.sum("total_linhas").alias("total_linhas"), F.count("num_uc_uci").alias("ucs_total"),
        *[F.sum(n).alias(n) for n in steps], F.sum((F.col(last) > 0).cast("long")).alias("ucs_liquidas"),
    )


def net_billed(base: DataFrame, billed: DataFrame) -> DataFrame:
    """Net rows of billed UCs (``billed.num_uc_uci`` distinct)."""
    return base.where(_audit_rule()).join(billed, "num_uc_uci", "left_semi")


def billed_effect(base: DataFrame, billed: DataFrame) -> DataFrame:
    rows = net_billed(base, billed)
    return rows.groupBy("cenario").agg(
        F.count("*").alias("linhas_liquidas_faturadas"), F.countDistinct("num_uc_uci").alias("ucs_liquidas_faturadas"),
        (F.sum("duracao_minutos_uc") / F.lit(60.0)).alias("soma_dic_horas"), F.countDistinct("num_seq_intrp").alias("soma_fic"),
    )


def two_denominators(base: DataFrame, billed: DataFrame, official: DataFrame) -> DataFrame:
    """DEC and FEC per region and company under the distinct-UC and the official denominator.

    ``official``: ``regional_origem, quantidade_ucs_iqs``, one row per region.
    """
    events = net_billed(base, billed).groupBy("cenario", "regional_origem", "num_uc_uci", "num_seq_intrp").agg(
        F.sum("duracao_minutos_uc").alias("m")
    )
    per_uc = events.groupBy("cenario", "regional_origem", "num_uc_uci").agg(
        (F.sum("m") / F.lit(60.0)).alias("dic"), F.count("num_seq_intrp").alias("fic")
    )
    sums = [F.sum("dic").alias("soma_dic_horas"), F.sum("fic").alias("soma_fic")]
    region = per_uc.groupBy("cenario", "regional_origem").agg(F.count("num_uc_uci").alias("denominador_oms"), *sums)
    again = [F.sum(c).alias(c) for c in ("denominador_oms", "soma_dic_horas", "soma_fic")]
    company = region.groupBy("cenario").agg(*again).withColumn("regional_origem", F.lit(S.COMPANY))
    official = official.where(F.col("regional_origem") != S.COMPANY)
    total = official.agg(F.sum("quantidade_ucs_iqs").alias("quantidade_ucs_iqs")).withColumn("regional_origem", F.lit(S.COMPANY))
    dens = stack(official, total).withColumnRenamed("quantidade_ucs_iqs", "denominador_iqs")
    rows = stack(region, company).join(dens, "regional_origem", "left")
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return rows.select(
        "cenario", "regional_origem", "soma_dic_horas", "soma_fic", "denominador_oms", "denominador_iqs",
        ratio("soma_dic_horas", "denominador_oms").alias("dec_com_den_oms"),
        ratio("soma_dic_horas", "denominador_iqs").alias("dec_com_den_iqs"),
        ratio("soma_fic", "denominador_oms").alias("fec_com_den_oms"),
        ratio("soma_fic", "denominador_iqs").alias("fec_com_den_iqs"),
    )


def compensation_totals(comp: DataFrame) -> DataFrame:
    return comp.groupBy("cenario").agg(
        F.count("*").alias("linhas"), F.countDistinct("uc").alias("ucs"),
        F.sum(F.col("possui_violacao").cast("long")).alias("linhas_com_violacao"),
        *[F.sum(f"compensacao_{s}").alias(f"soma_comp_{s}") for s in ("dic", "fic", "dmic")],
        F.sum("valor_ressarcimento_estimado").alias("valor_total"),
    )


def winning_indicator(comp: DataFrame) -> DataFrame:
    dic, fic, dmic = (F.col(f"compensacao_{s}") for s in ("dic", "fic", "dmic"))
    winner = (
        F.when(F.col("valor_ressarcimento_estimado") == 0, F.lit("SEM_VIOLACAO")).when((dic >= fic) & (dic >= dmic), F.lit("DIC"))
        .when((fic >= dic) & (fic >= dmic), F.lit("FIC")).otherwise(F.lit("DMIC"))
    )
    value = "valor_ressarcimento_estimado"
    return comp.withColumn("indicador_vencedor", winner).groupBy("cenario", "indicador_vencedor").agg(
        F.count("*").alias("linhas"), F.countDistinct("uc").alias("ucs"), F.sum(value).alias("valor_total"),
        F.avg(value).alias("valor_medio"), F.max(value).alias("maior_valor"),
    )


def value_by_voltage(comp: DataFrame) -> DataFrame:
    return comp.where("valor_ressarcimento_estimado > 0").groupBy(
        "cenario", F.coalesce("grupo_tensao", F.lit("SEM_GRUPO")).alias("grupo_tensao"),
        F.coalesce("nivel_tensao", F.lit("SEM_NIVEL")).alias("nivel_tensao"), "kei",
    ).agg(
        F.count("*").alias("linhas"), F.countDistinct("uc").alias("ucs"), F.sum("valor_ressarcimento_estimado").alias("valor_total"),
        F.avg("vrc").alias("vrc_medio"), F.max("vrc").alias("vrc_maximo"),
    )


def _repeated(comp: DataFrame) -> DataFrame:
    return comp.groupBy("cenario", "uc").agg(
        F.count("*").alias("qtd"), F.sum("valor_ressarcimento_estimado").alias("valor")
    ).where("qtd > 1")


def duplicate_summary(comp: DataFrame) -> DataFrame:
    return _repeated(comp).groupBy("cenario").agg(
        F.count("*").alias("ucs_duplicadas"), F.sum("qtd").alias("linhas_duplicadas"), F.sum("valor").alias("valor_em_duplicidade")
    )


def duplicate_detail(comp: DataFrame) -> DataFrame:
    return comp.join(_repeated(comp).select("cenario", "uc"), ["cenario", "uc"], "left_semi")


def vrc_distribution(comp: DataFrame) -> DataFrame:
    stats = comp.groupBy("cenario").agg(
        F.count("*").alias("linhas"), F.countDistinct("uc").alias("ucs"), F.min("vrc").alias("vrc_min"),
        F.avg("vrc").alias("vrc_avg"), F.max("vrc").alias("vrc_max"),
    )
    points = exact_quantiles(comp, ["cenario"], "vrc", {"vrc_p50": 0.5, "vrc_p90": 0.9, "vrc_p99": 0.99})
    return stats.join(points, "cenario")


def target_gaps(comp: DataFrame) -> DataFrame:
    """Null and zero targets per scenario."""
    limits = {"dic": "limite_dic_horas", "fic": "limite_fic", "dmic": "limite_dmic_horas"}
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return comp.groupBy("cenario").agg(
        *[count(F.col(c).isNull()).alias(f"meta_{s}_nula") for s, c in limits.items()],
        *[count(F.col(c) == 0).alias(f"meta_{s}_zero") for s, c in limits.items()],
        F.sum("valor_ressarcimento_estimado").alias("valor_total"),
    )


def _paid(done: str, limit: str, amount):
    return F.when(F.col(done) > F.col(limit), F.col("vrc") * amount * F.col("kei")).otherwise(F.lit(0.0))


PAIRS = {"dic": ("dic_horas", "limite_dic_horas"), "fic": ("fic", "limite_fic"), "dmic": ("dmic_horas", "limite_dmic_horas")}


def formula_comparison(comp: DataFrame) -> DataFrame:
    """Total under "realised total" and under "excess over target"."""
    total = F.greatest(*[_paid(d, m, F.col(d) / F.lit(730.0)) for d, m in PAIRS.values()])
    excess = F.greatest(*[_paid(d, m, (F.col(d) - F.col(m)) / F.lit(730.0)) for d, m in PAIRS.values()])
    per_uc = comp.withColumns({"_t": total, "_e": excess}).groupBy("cenario", "uc").agg(
        F.sum("_t").alias("t"), F.sum("_e").alias("e"), F.max(F.col("_t") > 0).alias("pt"), F.max(F.col("_e") > 0).alias("pe")
    )
    return per_uc.groupBy("cenario").agg(
        F.sum("t").alias("total_formula_atual"), F.sum("e").alias("total_formula_excedente"),
        (F.sum("t") - F.sum("e")).alias("diferenca"), F.sum(F.col("pt").cast("long")).alias("ucs_compensadas_atual"),
        F.sum(F.col("pe").cast("long")).alias("ucs_compensadas_excedente"),
    )


def fic_alternatives(comp: DataFrame) -> DataFrame:
    """Excess total with and without the monthly divisor on the event count."""
    part = {s: _paid(d, m, (F.col(d) - F.col(m)) / F.lit(730.0)) for s, (d, m) in PAIRS.items()}
    plain = _paid("fic", "limite_fic", F.col("fic") - F.col("limite_fic"))
    return comp.groupBy("cenario").agg(
        F.sum(F.greatest(part["dic"], part["fic"], part["dmic"])).alias("total_excedente_fic_div730"),
        F.sum(F.greatest(part["dic"], plain, part["dmic"])).alias("total_excedente_fic_sem_div730"),
    )


def negative_health(rows: DataFrame) -> DataFrame:
    """Rows and distinct events whose end precedes their start."""
    bad = rows.where(parse_ts("DATA_HORA_FIM_INTRP", native=False) < parse_ts("DATA_HORA_INIC_INTRP", native=False))
    return bad.agg(F.count("*").alias("registros_negativos"), F.countDistinct("NUM_SEQ_INTRP").alias("interrupcoes_negativas"))
