"""Continuity indicators: per UC, per level, before and after treatment; CI/CHI assessment; consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import (
    area_one, blank_to_null, is_blank, long_or_short, net_class, protocol_excludes, region, text, three_way_class,
)
from ..functions.time import elapsed_minutes, minute_boundaries, month_bounds, parse_ts
from ..operators.intervals import islands, light_and_heavy
from ..operators.relational import backfill, dedup_keep_incomplete, find_column, first_per_key, resolve, stack
from ..session import materialize

TS_COLUMNS = {
    "DATA_HORA_INIC_INTRP_TS": "timestamp_ntz", "DATA_HORA_FIM_INTRP_TS": "timestamp_ntz",
    "DTHR_INICIO_INTRP_UC_TS": "timestamp_ntz", "INDIC_SIT_PROCES_INDIC_UCI": "string",
}
GROUP = ["cenario", "anomes", "regional_origem", "cod_conjunto_aneel", "num_posto_uci", "num_uc_uci"]


def scenario_base(before: DataFrame, after: DataFrame, anomes: str) -> DataFrame:
    """Both scenarios stacked by name, with region, set, typed times and the minutes of each row."""
    rows = stack(before.withColumn("cenario", F.lit("antes")), after.withColumn("cenario", F.lit("depois")))
    rows = backfill(rows, TS_COLUMNS).where(F.nullif(text("NUM_UC_UCI"), F.lit("")).isNotNull())
    start = F.coalesce("DTHR_INICIO_INTRP_UC_TS", "DATA_HORA_INIC_INTRP_TS", parse_ts("DTHR_INICIO_INTRP_UC", native=False),
                       parse_ts("DATA_HORA_INIC_INTRP", native=False))
    end = F.coalesce("DATA_HORA_FIM_INTRP_TS", parse_ts("DATA_HORA_FIM_INTRP", native=False))
    return rows.select(
        "cenario", F.lit(anomes).alias("anomes"), region("SIGLA_REGIONAL", "REGIONAL_ORIGEM").alias("regional_origem"),
        F.coalesce(F.nullif(text("COD_CONJTO_ELET_ANEEL_INTRP"), F.lit("")), F.lit(S.NO_SET)).alias("cod_conjunto_aneel"),
        text("NUM_POSTO_UCI").alias("num_posto_uci"), text("NUM_UC_UCI").alias("num_uc_uci"),
        text("NUM_SEQ_INTRP").alias("num_seq_intrp"), text("NUM_INTRP_INIC_MANOBRA_UCI").alias("num_intrp_inic_manobra_uci"),
        start.alias("inicio_uc"), end.alias("fim_uc"), text("ESTADO_INTRP").alias("estado_intrp"),
        text("NUM_MOTIVO_TRAT_DIF_UCI").alias("motivo_tratamento"), text("TIPO_PROTOC_JUSTIF_UCI").alias("tipo_protocolo_uci"),
        text("INDIC_SIT_PROCES_INDIC_UCI").alias("indic_sit_proces_indic_uci"),
    ).withColumn("duracao_minutos_uc", minute_boundaries("inicio_uc", "fim_uc"))


def net_terms() -> dict[str, Column]:
    """The criteria of the net rule by name, over ``scenario_base``; all null-safe."""
    no = F.lit(False)
    return {
        "datas_validas": F.coalesce(F.col("duracao_minutos_uc") >= 0, no),
        "duracao_3min": F.coalesce(F.col("duracao_minutos_uc") >= 3, no),
        "estado_4": F.coalesce(F.col("estado_intrp") == S.STATE_ELIGIBLE, no),
        "protocolo_0": F.coalesce(F.trim("tipo_protocolo_uci") == "0", no),
        "motivo_nulo": is_blank("motivo_tratamento"),
        "indic_proces_nulo": is_blank("indic_sit_proces_indic_uci"),
    }


def net_rule() -> Column:
    return reduce(lambda a, b: a & b, net_terms().values())


def billed_ucs(billed: DataFrame) -> DataFrame:
    """Distinct billed UCs (flag ``S``). A UC listed in two regions counts once."""
    flag = F.upper(F.trim(text("faturado")))
    return resolve(billed, S.ALIASES["billed"], required=("uc", "faturado")).where(flag == "S").select(
        text("uc").alias("num_uc_uci")
    ).distinct()


def billed_filter(base: DataFrame, billed: DataFrame | None) -> DataFrame:
    """Keep rows of billed UCs and say in ``filtro_faturamento`` whether the filter ran."""
    if billed is None:
        return base.withColumn("filtro_faturamento", F.lit(S.BILLED_SKIPPED))
    if any(find_column(billed, S.ALIASES["billed"][c]) is None for c in ("uc", "faturado")):
        return base.withColumn("filtro_faturamento", F.lit(S.BILLED_BAD_COLUMNS))
    return base.join(billed_ucs(billed), "num_uc_uci", "left_semi").withColumn(
        "filtro_faturamento", F.lit(S.BILLED_APPLIED)
    )


def uc_indicators(base: DataFrame, run_ts: str, denominator_source: str = S.DENOMINATOR_DISTINCT) -> DataFrame:
    """DIC, FIC, DMIC per scenario, region, set, post and UC, over the net rows.

    FIC counts events without an initial manoeuvre, ``interrupcoes_distintas`` all events. Rows are first reduced
    to one per event, so both distinct counts become plain sums: one pass, no row expansion.
    """
    if "filtro_faturamento" not in base.columns:
        base = base.withColumn("filtro_faturamento", F.lit(S.BILLED_SKIPPED))
    free = is_blank("num_intrp_inic_manobra_uci")
    events = base.where(net_rule()).groupBy(*GROUP, "num_seq_intrp").agg(
        F.sum("duracao_minutos_uc").alias("_sum"), F.max("duracao_minutos_uc").alias("_max"),
        F.max(free & F.col("num_seq_intrp").isNotNull()).alias("_free"), F.max("filtro_faturamento").alias("_filter"),
    )
    return events.groupBy(*GROUP).agg(
        (F.sum("_sum") / F.lit(60.0)).alias("dic_horas"), F.sum(F.col("_free").cast("long")).alias("fic"),
        (F.max("_max") / F.lit(60.0)).alias("dmic_horas"), F.count("num_seq_intrp").alias("interrupcoes_distintas"),
        F.max("_filter").alias("filtro_faturamento"),
    ).withColumns({
        "fonte_denominador": F.lit(denominator_source), "regra_liquido": F.lit(S.NET_RULE), "gerado_em": F.lit(run_ts),
    })


def official_denominators(source: DataFrame) -> DataFrame:
    """UCs per region from a reference mart; its own company total row is left out."""
    rows = resolve(source, S.ALIASES["denominators"], required=("regional_origem", "quantidade_ucs"))
    label = F.coalesce(F.nullif(text("regional_origem"), F.lit("")), F.lit(S.NO_REGION))
    return rows.where(label != S.COMPANY).groupBy(label.alias("regional_origem")).agg(
        F.sum(text("quantidade_ucs").try_cast("double")).alias("_official")
    )


def denominators(base: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """UCs per (scenario, region): the official number where there is one, else the distinct UCs of the base."""
    own = base.groupBy("cenario", "regional_origem").agg(F.countDistinct("num_uc_uci").cast("double").alias("_own"))
    if official is None:
        return own.withColumnRenamed("_own", "quantidade_ucs")
    return own.join(official_denominators(official), "regional_origem", "left").select(
        "cenario", "regional_origem", F.coalesce("_official", "_own").alias("quantidade_ucs")
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))


LEVEL_COLUMNS = [
    "cenario", "anomes", "nivel", "regional_origem", "cod_conjunto_aneel", "quantidade_ucs", "soma_dic_horas", "soma_fic",
    "dec_horas", "fec", "dmic_max_horas", "fonte_denominador", "filtro_faturamento", "regra_liquido", "gerado_em",
]


def aggregate_levels(uc: DataFrame, dens: DataFrame, run_ts: str) -> DataFrame:
    """DEC and FEC for the company, each region and each electrical set.

    The levels differ in denominator, so they are three aggregates stacked, not a rollup. The company sums the
    denominators of regions that appear in ``uc``; a region without any net event is not part of it.
    """
    labels = [F.max(c).alias(c) for c in ("fonte_denominador", "filtro_faturamento", "regra_liquido")]
    sums = [F.sum("dic_horas").alias("soma_dic_horas"), F.sum("fic").alias("soma_fic"),
            F.max("dmic_horas").alias("dmic_max_horas")]
    per_region = uc.groupBy("cenario", "anomes", "regional_origem").agg(*sums, *labels)
    per_region = per_region.join(dens, ["cenario", "regional_origem"], "left").withColumns({
        "nivel": F.lit("REGIONAL"), "cod_conjunto_aneel": F.lit("TODOS"),
    })
    company = per_region.groupBy("cenario", "anomes").agg(
        F.sum("quantidade_ucs").alias("quantidade_ucs"), F.sum("soma_dic_horas").alias("soma_dic_horas"),
        F.sum("soma_fic").alias("soma_fic"), F.max("dmic_max_horas").alias("dmic_max_horas"), *labels,
    ).withColumns({
        "nivel": F.lit(S.COMPANY), "regional_origem": F.lit(S.COMPANY), "cod_conjunto_aneel": F.lit("TODOS"),
    })
    # Distinct UCs of a set: posts first, so the count is a plain sum over one row per UC.
    per_uc = uc.groupBy("cenario", "anomes", "regional_origem", "cod_conjunto_aneel", "num_uc_uci").agg(
        F.sum("dic_horas").alias("dic_horas"), F.sum("fic").alias("fic"), F.max("dmic_horas").alias("dmic_horas"), *labels
    )
    per_set = per_uc.groupBy("cenario", "anomes", "regional_origem", "cod_conjunto_aneel").agg(
        F.count("num_uc_uci").cast("double").alias("quantidade_ucs"), *sums, *labels
    ).withColumn("nivel", F.lit("CONJUNTO"))
    return stack(company, per_region, per_set).withColumns({
        "dec_horas": _ratio("soma_dic_horas", "quantidade_ucs"), "fec": _ratio("soma_fic", "quantidade_ucs"),
        "gerado_em": F.lit(run_ts),
    }).select(*LEVEL_COLUMNS)


def before_after(levels: DataFrame, run_ts: str) -> DataFrame:
    """Both scenarios side by side per (level, region, set, month); a key present in one only stays.

    One conditional aggregate instead of a full outer join of the table with itself.
    """
    key = ["anomes", "nivel", "regional_origem", "cod_conjunto_aneel"]
    side = lambda s, c: F.max(F.when(F.col("cenario") == s, F.col(c)))
    prefer_after = ["quantidade_ucs", "fonte_denominador", "filtro_faturamento", "regra_liquido"]
    measures = {"dec": "dec_horas", "fec": "fec", "dmic_max": "dmic_max_horas"}
    wide = levels.groupBy(*key).agg(
        *[F.coalesce(side("depois", c), side("antes", c)).alias(c) for c in prefer_after],
        *[side(s, c).alias(f"{n}_{s}") for n, c in measures.items() for s in ("antes", "depois")],
    )
    delta = lambda n: F.col(f"{n}_depois") - F.col(f"{n}_antes")
    percent = lambda n: delta(n) / F.nullif(F.col(f"{n}_antes"), F.lit(0.0)) * F.lit(100.0)
    return wide.select(
        *key, "quantidade_ucs", "dec_antes", "dec_depois", delta("dec").alias("dec_delta"),
        percent("dec").alias("dec_delta_percentual"), "fec_antes", "fec_depois", delta("fec").alias("fec_delta"),
        percent("fec").alias("fec_delta_percentual"), "dmic_max_antes", "dmic_max_depois",
        delta("dmic_max").alias("dmic_delta"), "fonte_denominador", "filtro_faturamento", "regra_liquido",
        F.lit(run_ts).alias("gerado_em"),
    )


def choose_denominator(billed_counts: DataFrame | None, consumer_counts: DataFrame | None) -> tuple[DataFrame | None, str]:
    """The first usable official source and its label: billed counts, then consumer counts, then none."""
    for frame, label in ((billed_counts, S.DENOMINATOR_BILLED), (consumer_counts, S.DENOMINATOR_CONSUMERS)):
        if frame is not None and all(find_column(frame, a) for a in S.ALIASES["denominators"].values()):
            return frame, label
    return None, S.DENOMINATOR_DISTINCT


def continuity_indicators(before: DataFrame, after: DataFrame, anomes: str, run_ts: str, billed: DataFrame | None = None,
                          billed_counts: DataFrame | None = None, consumer_counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All indicator tables of a month as lazy frames (``plans.trail`` stores ``indicadores_uc`` in between)."""
    base = billed_filter(scenario_base(before, after, anomes), billed)
    official, source = choose_denominator(billed_counts, consumer_counts)
    uc = uc_indicators(base, run_ts, source)
    levels = aggregate_levels(uc, denominators(base, official), run_ts)
    return {"indicadores_uc": uc, "indicadores_agregado": levels, "indicadores_comparativo": before_after(levels, run_ts)}


# --------------------------------------------------------------------------- CI / CHI assessment


def with_origin(df: DataFrame, fallbacks: tuple = ("SIGLA_REGIONAL", "regional")) -> DataFrame:
    """``arquivo_origem``: trimmed when present, else the first fallback column the frame has, else the company."""
    if "arquivo_origem" in df.columns:
        return df.withColumn("arquivo_origem", F.coalesce(F.trim(text("arquivo_origem")), F.lit("")))
    have = [c for c in fallbacks if c in df.columns]
    value = F.coalesce(F.trim(text(have[0])), F.lit("")) if have else F.lit("")
    return df.withColumn("arquivo_origem", F.when(value != "", value).otherwise(F.lit(S.COMPANY_TITLE)))


def classify_events(events: DataFrame) -> DataFrame:
    if "classificacao" in events.columns:
        return events
    protocols = [c for c in ("TIPO_PROTOC_JUSTIF_INTRP",) if c in events.columns]
    return events.withColumn("classificacao", net_class(*protocols))


def classify_uc_rows(rows: DataFrame) -> DataFrame:
    """Excluded/net class and area-one flag per UC row; net rows with a treatment reason leave."""
    protocols = [c for c in ("TIPO_PROTOC_JUSTIF_UCI", "TIPO_PROTOC_JUSTIF_INTRP") if c in rows.columns]
    if "is_expurgo" not in rows.columns:
        excluded = reduce(lambda a, b: a | b, [protocol_excludes(p) for p in protocols], F.lit(False))
        rows = rows.withColumn("is_expurgo", excluded)
    if "classificacao" not in rows.columns:
        rows = rows.withColumn("classificacao", F.when(F.col("is_expurgo"), F.lit("Expurgo")).otherwise(F.lit("Liquido")))
    if "is_area_i" not in rows.columns:
        area = area_one("COD_AREA_ELET_INTRP") if "COD_AREA_ELET_INTRP" in rows.columns else F.lit(False)
        rows = rows.withColumn("is_area_i", area)
    if "NUM_MOTIVO_TRAT_DIF_UCI" in rows.columns:
        rows = rows.where(~((F.col("classificacao") == "Liquido") & ~is_blank("NUM_MOTIVO_TRAT_DIF_UCI")))
    return rows


NEWEST = ("snapshot_ts", "DATA_HORA_FIM_INTRP", "arquivo_csv")


def keyed_uc_rows(rows: DataFrame) -> DataFrame:
    """The record key trimmed, the manoeuvre's event number standing in for the own one."""
    key = S.RECORD_KEY
    if not set(key) <= set(rows.columns):
        return rows
    if "NUM_INTRP_INIC_MANOBRA_UCI" in rows.columns:
        rows = rows.withColumn("NUM_INTRP_UCI", F.coalesce(blank_to_null("NUM_INTRP_INIC_MANOBRA_UCI"), text("NUM_INTRP_UCI")))
    return rows.withColumns({c: F.coalesce(F.trim(text(c)), F.lit("")) for c in key})


def dedup_uc_rows(rows: DataFrame, tiebreak: list | None = None, together: bool = False) -> DataFrame:
    """Newest row per record key (see ``keyed_uc_rows``); rows without a full key all stay."""
    if not set(S.RECORD_KEY) <= set(rows.columns):
        return rows
    order = [F.desc_nulls_last(c) for c in NEWEST if c in rows.columns]
    return dedup_keep_incomplete(rows, S.RECORD_KEY, order, tiebreak, together)


def typed_uc_rows(rows: DataFrame) -> DataFrame:
    """Times parsed where they are still text."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: parse_ts(c) for c in ("DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP") if kinds[c] == "string"})


def merged_periods(one: DataFrame, by_origin: bool = True, few: bool = False) -> DataFrame:
    """Periods without supply per UC (and origin) from rows without repeated keys: overlapping or touching rows
    merged, flags carried over. Those of a UC over all origins may be made of those by origin. ``few`` as for ``islands``."""
    key = (["arquivo_origem"] if by_origin else []) + ["NUM_UC_UCI"]
    merged = islands(one, key, "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", flags=("is_expurgo", "is_area_i"), few=few)
    if not by_origin:
        merged = merged.withColumn("arquivo_origem", F.lit(S.COMPANY_TITLE))
    minutes = elapsed_minutes("DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP")
    return merged.withColumn("duracao_min", F.greatest(minutes, F.lit(0.0))).withColumns({
        "chi_individual": F.col("duracao_min") / F.lit(60.0), "tipo_intrp": long_or_short("duracao_min"),
        "classificacao": F.when(F.col("is_expurgo"), F.lit("Expurgo")).otherwise(F.lit("Liquido")),
    })


def billed_list(source: DataFrame) -> DataFrame:
    """Distinct non-blank UCs of a billed list, under any accepted column name."""
    uc = resolve(source, S.ALIASES["billed_list"], required=("uc",)).select(blank_to_null("uc").alias("NUM_UC_UCI"))
    return uc.where(F.col("NUM_UC_UCI").isNotNull()).distinct()


def ci_chi(periods: DataFrame) -> DataFrame:
    """Customers interrupted and customer hours by origin and class: all, long, short, long in area one."""
    long, hours = F.col("tipo_intrp") == "Longa", F.col("chi_individual")
    sums = {"longa": ("CI_longa", "CHI_longa", long), "curta": ("CI_curta", "CHI_curta", ~long),
            "area": ("CIi_longa", "CHIi_longa", long & F.col("is_area_i"))}
    return periods.groupBy("arquivo_origem", "classificacao").agg(
        F.count("*").alias("CI"), F.sum(hours).alias("CHI"),
        *[c for ci, chi, test in sums.values() for c in (
            F.sum(test.cast("long")).alias(ci), F.sum(F.when(test, hours).otherwise(F.lit(0.0))).alias(chi))],
    )


def distinct_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct occurrences and events, a null counting as one value, by origin and class, and by class.

    Numbers of both kinds are told apart before anything is counted: one row for each (origin, class, kind, number), read for both.
    """
    numbers = F.array(*[F.struct(F.lit(kind).alias("tipo"), text(c).alias("numero")) for kind, c in enumerate(("NUM_OCORRENCIA_ADMS", "PID"))])
    named = materialize(events.select("arquivo_origem", "classificacao", F.explode(numbers).alias("_x")).select(
        "arquivo_origem", "classificacao", "_x.*").distinct(), "ci-chi-eventos")
    counts = [F.count(F.when(F.col("tipo") == kind, 1)).alias(c) for kind, c in enumerate(("qtd_ocorrencias_distintas", "qtd_interrupcoes_distintas"))]
    return (named.groupBy("arquivo_origem", "classificacao").agg(*counts),
            named.drop("arquivo_origem").distinct().groupBy("classificacao").agg(*counts))


def periods_by_level(rows: DataFrame, tiebreak: list) -> tuple[DataFrame, DataFrame]:
    """Periods of each UC by origin, and over all origins, of stored rows that may repeat a key.

    Rows of UCs with a handful move once, by UC: there repeated keys leave and both merges run. Those of other UCs are
    deduplicated by key and stored, as two merges with keys of their own read them.
    """
    # Rows equal in all that is ranked so far differ in these at most, so both levels see the same row.
    tiebreak = [*tiebreak, "arquivo_origem", "is_expurgo", "is_area_i"]
    light, heavy = light_and_heavy(rows, ["NUM_UC_UCI"], nulls=True)
    by_origin = merged_periods(dedup_uc_rows(light.repartition("NUM_UC_UCI"), tiebreak, together=True), True, few=True)
    overall = merged_periods(by_origin, False, few=True)
    if heavy is None:
        return by_origin, overall
    one = materialize(dedup_uc_rows(heavy, tiebreak).select(*PERIOD_COLUMNS), "ci-chi")
    return by_origin.unionByName(merged_periods(one, True)), overall.unionByName(merged_periods(one, False))


PERIOD_COLUMNS = ["arquivo_origem", "NUM_UC_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", "is_expurgo", "is_area_i"]
RATES = {"FEC": "CI_longa", "DEC": "CHI_longa", "FM_fec": "CI_curta", "FM_dec": "CHI_curta", "FECi": "CIi_longa", "DECi": "CHIi_longa"}
SUMMARY_COLUMNS = [
    "arquivo_origem", "classificacao", "CI", "CHI", "qtd_intrp_longas", "qtd_intrp_curtas", "qtd_ocorrencias_distintas",
    "qtd_interrupcoes_distintas", "consumidores", "mes", *RATES,
]


def rates(metrics: DataFrame) -> DataFrame:
    """Frequency and duration rates per consumer; 0 without consumers."""
    consumers = F.col("consumidores")
    return metrics.withColumns({
        "qtd_intrp_longas": F.col("CI_longa"), "qtd_intrp_curtas": F.col("CI_curta"),
        **{n: F.when(consumers > 0, F.col(c) / consumers).otherwise(F.lit(0.0)) for n, c in RATES.items()},
    }).select(*SUMMARY_COLUMNS)


def assess_ci_chi(events: DataFrame, uc_rows: DataFrame, billed: DataFrame, consumers: DataFrame,
                  tiebreak: list | None = None) -> dict[str, DataFrame]:
    """CI/CHI summary by origin and class plus the company rows, whose periods are merged over all origins.

    ``consumers``: one row per region (``regional, consumidores, mes``).
    """
    events = classify_events(with_origin(events))
    rows = classify_uc_rows(typed_uc_rows(with_origin(uc_rows)))
    if set(S.RECORD_KEY) <= set(rows.columns):
        rows = rows.withColumn("NUM_UC_UCI", F.coalesce(F.trim(text("NUM_UC_UCI")), F.lit("")))
    # The UC is part of the key of the dedup and of the merge, so keeping billed UCs first gives the same rows and
    # shuffles fewer. The rows are stored because their UCs are counted before they move.
    rows = keyed_uc_rows(rows.join(billed_list(billed), "NUM_UC_UCI", "left_semi"))
    if tiebreak is None:
        rest = sorted(set(rows.columns) - set(S.RECORD_KEY))
        kept = [c for c in dict.fromkeys([*PERIOD_COLUMNS, *S.RECORD_KEY, *NEWEST]) if c in rows.columns]
        rows, tiebreak = rows.select(*kept, F.xxhash64(*rest).alias("_h")), ["_h"]
    per_origin, overall = periods_by_level(materialize(rows, "ci-chi"), tiebreak)
    events_by_origin, events_of_company = distinct_events(events)
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("qtd_ocorrencias_distintas", "qtd_interrupcoes_distintas")}
    side = consumers.select(F.col("regional").alias("arquivo_origem"), F.col("consumidores").cast("double").alias("consumidores"),
                            F.col("mes").cast("long").alias("mes"))
    by_origin = rates(
        ci_chi(per_origin).join(events_by_origin, ["arquivo_origem", "classificacao"], "left")
        .withColumns(filled).join(side, "arquivo_origem", "left")
    )
    total = side.agg(F.sum("consumidores").alias("consumidores"), F.min("mes").alias("mes")).withColumn(
        "arquivo_origem", F.lit(S.COMPANY_TITLE)
    )
    company = rates(
        ci_chi(overall).join(events_of_company, "classificacao", "left").withColumns(filled)
        .join(total, "arquivo_origem", "left")
    )
    return {"resumo": stack(by_origin, company), "origem": by_origin, "empresa": company}


def area_rank(col: str = "arquivo_origem") -> Column:
    """Presentation order: regions, others, company."""
    out = F.lit(998)
    for i, name in reversed(list(enumerate(S.REGIONS))):
        out = F.when(F.col(col) == name, F.lit(i)).otherwise(out)
    return F.when(F.upper(F.col(col)) == S.COMPANY, F.lit(999)).otherwise(out)


def class_rank(col: str = "classificacao", order: tuple = ("Expurgo", "Liquido")) -> Column:
    out = F.lit(9)
    for i, name in enumerate(order):
        out = F.when(F.col(col) == name, F.lit(i)).otherwise(out)
    return out


# ------------------------------------------------------------------------------ consistency


def consistency_by_region(affected: DataFrame, events: DataFrame, uc_region: DataFrame, official: DataFrame, anomes: str) -> DataFrame:
    """CI, CHI, FEC and DEC by region and class, with gross and company rows.

    ``affected``: UC history rows (``num_uc, num_posto, num_evento, num_manobra, dt_ini, protocolo, motivo, faturado``);
    ``events``: ``num_evento, dt_fim, protocolo_evento``; ``uc_region``: ``num_uc, regional``; ``official``: billed
    consumers per region (``regional, uc_faturada``). Periods are found across classes and then reported per class.
    UCs without a region, or in the region the regulator leaves out, do not count.
    """
    uc_region = uc_region.where(F.col("regional") != "SCD")
    official = official.where(F.col("regional") != "SCD")
    first, after = month_bounds(anomes)
    month = affected.where((F.col("dt_ini") >= first) & (F.col("dt_ini") < after))
    billed = month.where(F.col("faturado") == "S").select("num_uc").distinct()
    rows = (
        month.join(billed, "num_uc", "left_semi").join(uc_region, "num_uc").join(events, "num_evento", "left")
    )
    rows = rows.select(
        F.col("regional").alias("arquivo_origem"), F.trim("num_uc").alias("num_uc"),
        F.trim("num_posto").alias("num_posto"), "dt_ini", "dt_fim",
        F.coalesce(blank_to_null("num_manobra"), F.trim("num_evento")).alias("num_intrp_key"),
        three_way_class("motivo", F.coalesce(F.nullif("protocolo", F.lit("")), F.nullif("protocolo_evento", F.lit("")), F.lit("0"))).alias("classificacao"),
    ).where(F.col("classificacao") != "Ignorar")
    order = [F.desc_nulls_last("dt_fim"), F.asc_nulls_last("dt_ini"), F.asc("classificacao"), F.asc("arquivo_origem")]
    one = materialize(first_per_key(rows, ["num_intrp_key", "num_posto", "num_uc"], order), "consistencia")
    periods = islands(one, ["arquivo_origem", "num_uc"], "dt_ini", "dt_fim", per=("classificacao",))
    minutes = elapsed_minutes("dt_ini", "dt_fim")
    long, hours = minutes >= 3, minutes / F.lit(60.0)
    base = periods.groupBy("arquivo_origem", "classificacao").agg(
        F.count("*").alias("ci"), F.sum(hours).alias("chi"), F.sum(long.cast("long")).alias("ci_longa"),
        F.sum(F.when(long, hours).otherwise(F.lit(0.0))).alias("chi_longa_s"),
    )
    sums = [F.sum(c).alias(c) for c in ("ci", "chi", "ci_longa", "chi_longa_s")]
    market = official.select(F.col("regional").alias("arquivo_origem"), F.col("uc_faturada").cast("double").alias("mercado_faturado"))
    gross = base.groupBy("arquivo_origem").agg(*sums).withColumn("classificacao", F.lit("Bruto"))
    regional = stack(base, gross).join(market, "arquivo_origem", "left")
    company = base.groupBy("classificacao").agg(*sums)
    company = stack(company, base.agg(*sums).withColumn("classificacao", F.lit("Bruto")))
    total = market.agg(F.sum("mercado_faturado").alias("mercado_faturado")).withColumn("arquivo_origem", F.lit(S.COMPANY))
    company = company.withColumn("arquivo_origem", F.lit(S.COMPANY)).join(total, "arquivo_origem", "left")
    rate = lambda c: F.when(F.col("mercado_faturado") > 0, F.col(c) / F.col("mercado_faturado")).otherwise(F.lit(0.0))
    return stack(regional, company).select(
        F.lit(anomes).alias("yyyymm"), "arquivo_origem", "classificacao", "ci", "chi", "ci_longa", "chi_longa_s",
        "mercado_faturado", rate("ci_longa").alias("fec"), rate("chi_longa_s").alias("dec"),
    )
