"""Reference data: distinct marts, consumer and billing counts by region, device history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import text
from ..functions.time import month_bounds
from ..operators.intervals import contained
from ..operators.relational import stack


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text under upper-case names."""
    return df.select(*[text(c).alias(c.upper()) for c in df.columns])


def distinct_mart(df: DataFrame) -> DataFrame:
    return df.distinct()


def marts_summary(spark, sources: dict[str, DataFrame | None]) -> DataFrame:
    """Rows before and after ``distinct`` per source; a missing source is a status, not a failure."""
    rows = []
    for name, df in sources.items():
        label = F.lit(name).alias("fonte")
        if df is None:
            one = spark.range(1).select(label, F.lit(0).cast("long").alias("linhas_raw"), F.lit(0).cast("long").alias("linhas_mart"),
                                        F.lit("pendente_raw").alias("status"))
        else:
            per_value = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
            one = per_value.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("linhas_raw"), F.count("*").alias("linhas_mart")).select(
                label, "linhas_raw", "linhas_mart", F.lit("processado").alias("status")
            )
        rows.append(one)
    return stack(*rows)


def _company(label: str) -> Column:
    return F.when(F.grouping(label) == 1, F.lit(S.COMPANY)).otherwise(F.col(label))


def with_region(ucs: DataFrame, localities: DataFrame, sections: DataFrame, regions: DataFrame,
                local: str = "cod_local", section: str = "cod_seccional", region: str = "cod_regional") -> DataFrame:
    """Customers with the columns of their locality, its section and the section's region; unknown ones stay, with nulls.

    Each dimension has one row per code, under the column that the level below refers to it by.
    """
    return ucs.join(localities, local, "left").join(sections, section, "left").join(regions, region, "left")


def consumers_by_region(ucs: DataFrame) -> DataFrame:
    """UCs, urban, rural and reference values by region with the company total.

    ``ucs``: ``regional, local ('U'/'R'), situacao, vrc``.
    """
    value = F.coalesce("vrc", F.lit(0.0))
    urban, rural = F.col("local") == "U", F.col("local") == "R"
    return ucs.where(F.col("situacao").isin(S.ACTIVE_UC_STATES)).rollup("regional").agg(
        _company("regional").alias("REGIONAL_TOTAL"), F.count("*").alias("UC"),
        F.count(F.when(urban, 1)).alias("UC_URBANA"), F.count(F.when(rural, 1)).alias("UC_RURAL"), F.sum(value).alias("VRC"),
        F.sum(F.when(urban, value).otherwise(F.lit(0.0))).alias("VRC_URBANO"),
        F.sum(F.when(rural, value).otherwise(F.lit(0.0))).alias("VRC_RURAL"),
    ).drop("regional")


def _code(mapping: dict, region: Column) -> Column:
    out = F.lit(S.COMPANY)
    for key, value in mapping.items():
        out = F.when(region == key, F.lit(value)).otherwise(out)
    return out


def billed_by_region(counts: DataFrame) -> DataFrame:
    """Billed UCs by region and month with the company total, and the codes each region goes by.

    ``counts``: ``regional, anomes, urbano, rural``.
    """
    letters = {region: letter for letter, region in S.REGION_BY_LETTER.items()}
    rows = counts.where(F.col("regional") != "SCD").rollup("anomes", "regional").agg(
        F.sum(F.col("urbano") + F.col("rural")).alias("UC_faturada"), _company("regional").alias("REGIONAL_TOTAL"),
        F.grouping("anomes").alias("_all"),
    ).where("_all = 0")
    return rows.select(
        "REGIONAL_TOTAL", _code(letters, F.col("regional")).alias("SIGLA_REGIONAL"),
        _code(S.SERVER_BY_REGION, F.col("regional")).alias("SIGLA_SEVIDOR"), "anomes", "UC_faturada",
    )


def billed_uc_extract(history: DataFrame, anomes: str) -> DataFrame:
    """Distinct UCs of a month with billing flag and region (``uc, faturado, letra, acessante, dt_ini``)."""
    region = F.lit(S.COMPANY)
    for letter, name in S.REGION_BY_LETTER.items():
        region = F.when(F.col("letra") == letter, F.lit(name)).otherwise(region)
    first, after = month_bounds(anomes)
    return history.where((F.col("dt_ini") >= first) & (F.col("dt_ini") < after) & (F.col("acessante") == "N")).select(
        "uc", "faturado", region.alias("regional")
    ).distinct()


def vrc_extract(ucs: DataFrame) -> DataFrame:
    """Reference value of every active UC."""
    return ucs.where(F.col("situacao").isin(S.ACTIVE_UC_STATES)).select(
        "ISN_UC", "cea", "urb_rur", F.col("grupo").alias("COD_GRUPO_NIVEL_TENSAO_UC"),
        F.col("nivel").alias("COD_NIVEL_TENSAO_UC"), F.coalesce("vrc", F.lit(0.0)).alias("VRC"),
    )


def device_containment_history(events: DataFrame, affected: DataFrame, anomes: str) -> DataFrame:
    """Keep/exclude analysis of a month's device events from history, with affected UCs per protocol.

    ``events``: ``ocorrencia, interrupcao (number), tipo_chave, device, inicio, fim, tipo_eqp, causa, comp, tipo,
    protocolo``; ``affected``: ``interrupcao, protocolo_uc, uc``. Affected rows are counted per (event, protocol)
    before they meet the events, so an outage with very many UCs joins as one row.
    """
    first, after = month_bounds(anomes)
    rows = events.where(
        (F.col("inicio") >= first) & (F.col("inicio") < after) & (F.col("tipo_eqp") == "C") & F.col("device").isNotNull()
        & F.col("fim").isNotNull()
    )
    judged = contained(rows, ["device"], "interrupcao", "interrupcao")
    counts = affected.groupBy("interrupcao", "protocolo_uc").agg(F.count("uc").alias("UC_afetadas"))
    return judged.join(counts, "interrupcao").select(
        F.col("device").alias("NUMERO_OPERACIONAL"), "ocorrencia", "interrupcao", "tipo_chave",
        F.col("inicio").alias("DATA_INICIO"), F.col("fim").alias("DATA_FIM"),
        F.when(F.col("contido"), F.lit("EXCLUIR (Contido em outra)")).otherwise(F.lit("MANTER (OK)")).alias("SITUACAO"),
        F.col("causa").alias("COD_CAUSA_INTRP"), F.col("comp").alias("COD_COMP_INTRP"), F.col("tipo").alias("COD_TIPO_INTRP"),
        F.col("protocolo").alias("TIPO_PROTOC_JUSTIF_INTRP"), F.col("protocolo_uc").alias("tipo_protocolo_hcai"), "UC_afetadas",
    )
