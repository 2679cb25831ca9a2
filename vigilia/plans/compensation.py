"""Financial compensation from indicators, targets and reference values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import band_value, class_value, kei, num_br, text
from ..operators.relational import find_column, resolve

LIMITS = ("limite_dic_horas", "limite_fic", "limite_dmic_horas")
DONE = ("dic_horas", "fic", "dmic_horas")
SHORT = ("dic", "fic", "dmic")


def normalise_indicators(ind: DataFrame) -> DataFrame:
    """Indicators under any accepted names; the scenario is read from its label; missing numbers are 0."""
    rows = resolve(ind, S.ALIASES["indicators"], required=("uc",))
    has_scenario = find_column(ind, S.ALIASES["indicators"]["cenario"]) is not None
    label = F.lower(text("cenario")) if has_scenario else F.lit("apuracao")
    scenario = F.when(label.contains("antes"), F.lit("antes")).when(
        label.contains("depois") | label.contains("trat"), F.lit("depois")
    ).otherwise(label)
    place = text("regional") if find_column(ind, S.ALIASES["indicators"]["regional"]) else F.lit(S.COMPANY)
    return rows.select(
        text("uc").alias("uc"), scenario.alias("cenario"), place.alias("regional"),
        *[F.coalesce(num_br(c), F.lit(0.0)).alias(c) for c in DONE],
    )


def normalise_targets(targets: DataFrame) -> DataFrame:
    """One target row per UC: the largest value of each column."""
    rows = resolve(targets, S.ALIASES["targets"], required=("uc",))
    texts = ["conjunto_aneel", "ano_ref", "urb_rur", "grupo_tensao", "nivel_tensao"]
    return rows.groupBy(text("uc").alias("uc")).agg(
        *[F.max(text(c)).alias(f"meta_{c}") for c in texts], *[F.max(num_br(c)).alias(c) for c in LIMITS],
        F.max(num_br("valor")).alias("valor_meta"),
    )


def normalise_vrc(vrc: DataFrame, per_column: bool = False) -> DataFrame:
    """One reference row per UC, the one with the highest value (partial maxima before the exchange); with
    ``per_column`` the largest value of each column, as the earlier form has it."""
    rows = resolve(vrc, S.ALIASES["vrc"], required=("uc",))
    texts = ["conjunto_aneel", "urb_rur", "grupo_tensao", "nivel_tensao"]
    if per_column:
        return rows.groupBy(text("uc").alias("uc")).agg(
            F.max(num_br("vrc")).alias("vrc"), *[F.max(text(c)).alias(f"vrc_{c}") for c in texts]
        )
    best = F.max(F.struct(
        num_br("vrc").alias("vrc"), *[text(c).alias(c) for c in texts]
    )).alias("_b")
    return rows.groupBy(text("uc").alias("uc")).agg(best).select(
        "uc", F.col("_b.vrc").alias("vrc"), *[F.col(f"_b.{c}").alias(f"vrc_{c}") for c in texts]
    )


def empty_vrc(spark) -> DataFrame:
    return spark.createDataFrame([], "uc string, cea string, urb_rur string, grupo_tensao string, nivel_tensao string, vrc double")


def _pay(value: str, done: Column, amount: Column | None = None) -> Column:
    return F.col(value) * ((amount if amount is not None else done) / F.lit(S.HOURS_IN_MONTH)) * F.col("kei")


def compensation(ind: DataFrame, targets: DataFrame, anomes: str, run_ts: str, vrc: DataFrame | None = None) -> DataFrame:
    """Compensation per scenario and UC row: the largest of the three violated indicators.

    A missing target is never violated, a target of 0 is violated by any value; a missing reference value is 0.
    Targets and reference values have one row per UC, so the joins never multiply rows.
    """
    side = normalise_vrc(vrc if vrc is not None else empty_vrc(ind.sparkSession))
    base = normalise_indicators(ind).join(normalise_targets(targets), "uc", "left").join(side, "uc", "left")
    both = lambda c: F.coalesce(F.col(f"vrc_{c}"), F.col(f"meta_{c}"))
    base = base.select(
        F.lit(anomes).alias("anomes"), "uc", "cenario", "regional", both("conjunto_aneel").alias("conjunto_aneel"),
        both("urb_rur").alias("urb_rur"), both("grupo_tensao").alias("grupo_tensao"), both("nivel_tensao").alias("nivel_tensao"),
        F.coalesce("vrc", F.lit(0.0)).alias("vrc"), F.col("meta_ano_ref").alias("ano_ref"), *DONE, *LIMITS,
    ).withColumn("kei", kei("grupo_tensao", "nivel_tensao"))
    for short, done, limit in zip(SHORT, DONE, LIMITS):
        broken = F.coalesce(F.col(done) > F.col(limit), F.lit(False))
        base = base.withColumn(f"viola_{short}", broken).withColumn(
            f"compensacao_{short}", F.when(broken, _pay("vrc", F.col(done))).otherwise(F.lit(0.0))
        )
    return base.withColumns({
        "possui_violacao": F.col("viola_dic") | F.col("viola_fic") | F.col("viola_dmic"),
        "valor_ressarcimento_estimado": F.greatest(*[f"compensacao_{s}" for s in SHORT]),
        "status_formula": F.lit(S.FORMULA_V2), "criterio_liquido": F.lit(S.NET_CRITERION), "materializado_em": F.lit(run_ts),
    })


def compensation_excess(ind: DataFrame, targets: DataFrame, run_ts: str, vrc: DataFrame | None = None) -> DataFrame:
    """The earlier form: shows the excess over each target; a target of 0 or none pays nothing; without any
    reference value the components are null and the total is 0."""
    side = normalise_vrc(vrc if vrc is not None else empty_vrc(ind.sparkSession), per_column=True)
    base = ind.withColumn("uc", text("num_uc_uci")).join(normalise_targets(targets), "uc", "left").join(side, "uc", "left")
    base = base.withColumns({
        "valor_referencia_ressarcimento": F.coalesce("vrc", "valor_meta"),
        "kei": kei("vrc_grupo_tensao", "vrc_nivel_tensao"),
    })
    value = F.col("valor_referencia_ressarcimento")
    columns = {}
    for short, done, limit in zip(SHORT, DONE, LIMITS):
        excess = F.greatest(F.col(done) - F.col(limit), F.lit(0.0))
        columns[f"excedente_{done}"] = excess
        columns[f"violou_{short}"] = F.coalesce(excess, F.lit(0.0)) > 0
        columns[f"compensacao_{short}"] = F.when(value.isNull(), F.lit(None).cast("double")).when(
            F.coalesce(F.col(limit), F.lit(0.0)) <= 0, F.lit(0.0)
        ).when(F.col(done) > F.col(limit), _pay("valor_referencia_ressarcimento", F.col(done))).otherwise(F.lit(0.0))
    has_value = find_column(targets, S.ALIASES["targets"]["valor"]) is not None
    status = S.FORMULA_V1_VRC if vrc is not None else (S.FORMULA_V1_VALUE if has_value else S.FORMULA_V1_NONE)
    out = base.withColumns(columns).withColumns({
        "possui_violacao": F.col("violou_dic") | F.col("violou_fic") | F.col("violou_dmic"),
        "valor_ressarcimento_estimado": F.greatest(*[F.coalesce(f"compensacao_{s}", F.lit(0.0)) for s in SHORT]),
        "status_formula_ressarcimento": F.lit(status), "gerado_em": F.lit(run_ts),
    })
    keep = [c for c in ("cenario", "anomes", "regional_origem", "cod_conjunto_aneel", "num_posto_uci", "num_uc_uci") if c in ind.columns]
    return out.select(
        *keep, *DONE, *LIMITS, F.col("meta_conjunto_aneel").alias("cod_conjunto_aneel_meta"), F.col("meta_ano_ref").alias("ano_ref_meta"),
        F.col("vrc_conjunto_aneel").alias("cea_vrc"), F.col("vrc_urb_rur").alias("urb_rur"),
        F.col("vrc_grupo_tensao").alias("cod_grupo_nivel_tensao_uc"), F.col("vrc_nivel_tensao").alias("cod_nivel_tensao_uc"),
        "valor_referencia_ressarcimento", "kei", *columns, "possui_violacao", "valor_ressarcimento_estimado",
        "status_formula_ressarcimento", "gerado_em",
    )


def compensation_summary(comp: DataFrame, by: tuple = ("cenario",)) -> DataFrame:
    """Rows, UCs, UCs with a violation and value, per scenario or any other columns."""
    uc = "uc" if "uc" in comp.columns else "num_uc_uci"
    per_uc = comp.groupBy(*by, uc).agg(
        F.count("*").alias("_rows"), F.sum(F.col("possui_violacao").cast("long")).alias("_broken"),
        F.sum("valor_ressarcimento_estimado").alias("_value"),
    )
    return per_uc.groupBy(*by).agg(
        F.sum("_rows").alias("registros"), F.count(uc).alias("ucs"), F.sum("_broken").alias("violacoes"),
        F.sum((F.col("_broken") > 0).cast("long")).alias("ucs_com_violacao"), F.sum("_value").alias("valor_estimado"),
    )


def compensation_order(comp: DataFrame) -> list[Column]:
    uc = "uc" if "uc" in comp.columns else "num_uc_uci"
    return [F.desc_nulls_last("valor_ressarcimento_estimado"), F.asc(uc), F.asc("cenario")]


# ------------------------------------------------------------------------------------------- targets


def set_limits(targets: DataFrame, values: DataFrame) -> DataFrame:
    """DEC and FEC limit per set and year: the December value of the two indicator types.

    ``targets``: ``num_meta, cea, tipo_indicador, ano_ref``; ``values``: ``num_meta, mes, valor`` (decimal comma text).
    """
    rows = targets.where(F.col("tipo_indicador").isin(S.TARGET_INDICATOR_DEC, S.TARGET_INDICATOR_FEC)).join(values, "num_meta")
    december = lambda kind: F.max(F.when(
        (F.col("tipo_indicador") == kind) & (F.col("mes") == S.TARGET_MONTH), num_br("valor")
    ))
    return rows.groupBy("cea", "ano_ref").agg(
        december(S.TARGET_INDICATOR_DEC).alias("limite_dec"), december(S.TARGET_INDICATOR_FEC).alias("limite_fec")
    )


def uc_targets(ucs: DataFrame, limits: DataFrame, voltages: DataFrame, year: int) -> DataFrame:
    """Targets of every active UC for a year.

    ``ucs``: ``ISN_UC, cea, urb_rur, grupo, nivel, situacao``; ``voltages``: ``grupo, nivel, descricao``. The band tables are
    expressions, so nothing is joined for them.
    """
    base = (
        ucs.where(F.col("situacao").isin(S.ACTIVE_UC_STATES))
        .join(limits.where(F.col("ano_ref") == year), "cea").join(voltages, ["grupo", "nivel"])
    )
    args = ("grupo", "nivel", "urb_rur")
    banded = {n: band_value(steps, *args, limit).cast("double") for n, (limit, steps) in S.TARGET_BANDS.items()}
    plain = {n: class_value(rules, *args) for n, rules in S.CLASS_TARGETS.items()}
    return base.select(
        "ISN_UC", F.col("cea").alias("COD_CONJUNTO_ANEEL"), "ano_ref", "urb_rur", F.col("grupo").alias("COD_GRUPO_NTFN"),
        F.col("nivel").alias("COD_NTFN"), F.col("descricao").alias("DESC_NTFN"), F.col("limite_dec").alias("META_DEC"),
        F.col("limite_fec").alias("META_FEC"), *[c.alias(n) for n, c in {**banded, **plain}.items()],
    )
