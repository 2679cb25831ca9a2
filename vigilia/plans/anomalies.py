"""Analyses the domain documents describe: critical days, daily steps, blocks, mixing, diffs, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import overlaps_any, temporal_blocks
from ..operators.relational import mode_per_group, top_n

# Limits of the documented rules.
MIN_ISE_CHI = 700000.0
REVIEW_CHI = 2000.0
DONE_STATUS = "14"


def longest_per_group(rows: DataFrame, group: str = "PID_INTRP_CONJTO_PIN", duration: str = "duracao", n: int = 3,
                      ties: tuple = ()) -> DataFrame:
    """The ``n`` longest rows of each group."""
    return top_n(rows, [group], [F.desc_nulls_last(duration), *[F.asc_nulls_last(c) for c in ties]], n)


def services_per_day(rows: DataFrame, group: str, moment: str, service: str, excluded: Column | None = None) -> DataFrame:
    """Distinct services per group and day, excluded rows left out."""
    kept = rows if excluded is None else rows.where(~excluded)
    return kept.groupBy(group, F.to_date(moment).alias("dia")).agg(F.countDistinct(service).alias("qtd_servicos"))


def critical_days(daily: DataFrame, group: str, history: Column | None = None, sigmas: float = 3.0) -> DataFrame:
    """Days whose count exceeds mean + 3 standard deviations of the group's history."""
    base = daily if history is None else daily.where(history)
    stats = base.groupBy(group).agg(
        F.avg("qtd_servicos").alias("media_hist"), F.coalesce(F.stddev_samp("qtd_servicos"), F.lit(0.0)).alias("desvio_hist")
    )
    out = daily.join(stats, group, "left").withColumn("limite_3sigma", F.col("media_hist") + F.lit(sigmas) * F.col("desvio_hist"))
    return out.withColumn("flag_anomalia", F.coalesce(F.col("qtd_servicos") > F.col("limite_3sigma"), F.lit(False)))


def daily_steps(daily: DataFrame, targets: DataFrame, group: str = "conjunto") -> DataFrame:
    """Daily step of cumulative DEC and FEC against the daily target, with priority.

    ``daily``: ``group, dia, dec_acum_mensal, fec_acum_mensal, dec_acum_anual, fec_acum_anual``; ``targets``: ``group,
    meta_dec, meta_fec`` (the larger one counts when a group repeats). A window holds one month of a group.
    """
    one = targets.groupBy(group).agg(F.max("meta_dec").alias("meta_dec"), F.max("meta_fec").alias("meta_fec"))
    month = Window.partitionBy(group, F.date_format("dia", "yyyyMM")).orderBy("dia")
    rows = daily
    for m in ("dec", "fec"):
        rows = rows.withColumn(f"degrau_dia_{m}", F.col(f"{m}_acum_mensal") - F.coalesce(F.lag(f"{m}_acum_mensal").over(month), F.lit(0.0)))
    rows = rows.join(one, group, "left")
    days = F.when(F.dayofyear(F.last_day(F.make_date(F.year("dia"), F.lit(12), F.lit(1)))) == 366, F.lit(366.0)).otherwise(F.lit(365.0))
    for m in ("dec", "fec"):
        rows = rows.withColumn(f"razao_dia_meta_{m}", F.col(f"degrau_dia_{m}") / F.nullif(F.col(f"meta_{m}") / days, F.lit(0.0)))
    ratio = {m: F.coalesce(F.col(f"razao_dia_meta_{m}"), F.lit(0.0)) for m in ("dec", "fec")}
    over = {m: (ratio[m] > 1) & F.coalesce(F.col(f"{m}_acum_anual") > F.col(f"meta_{m}"), F.lit(False)) for m in ("dec", "fec")}
    return rows.withColumn(
        "prioridade",
        F.when((ratio["dec"] >= 2) | (ratio["fec"] >= 2), F.lit("ALTA")).when(over["dec"] | over["fec"], F.lit("MEDIA"))
        .otherwise(F.lit("SEM_PRIORIDADE")),
    )


def impact_rules(rows: DataFrame) -> DataFrame:
    """One row per violated impact rule: short with net impact, protocol 1 and 6 with net impact."""
    impact = (F.coalesce("ci_liquido", F.lit(0)) > 0) | (F.coalesce("chi_liquido", F.lit(0)) > 0)
    rule = lambda test, name, severity: F.when(test & impact, F.struct(F.lit(name).alias("regra"), F.lit(severity).alias("severidade")))
    found = F.array_compact(F.array(
        rule(F.col("duracao_min") < 3, "ERRO_GRAVE_DURACAO_CURTA_COM_IMPACTO", "P0"),
        rule(F.col("tipo_protocolo") == "1", "ERRO_GRAVE_PROTOCOLO_1_COM_IMPACTO_LIQUIDO", "P0"),
        rule(F.col("tipo_protocolo") == "6", "ALERTA_PROTOCOLO_6_COM_IMPACTO_LIQUIDO", "BAIXA"),
    ))
    return rows.withColumn("_r", F.explode(found)).select("*", "_r.regra", "_r.severidade").drop("_r")


def service_impact(services: DataFrame) -> DataFrame:
    """CI and CHI of a service; only a finished one (status 14) has impact, and one without an end is flagged."""
    done = F.col("status_servico") == DONE_STATUS
    seconds = F.unix_timestamp(F.col("fim").cast("timestamp")) - F.unix_timestamp(F.col("inicio").cast("timestamp"))
    hours = seconds / F.lit(3600.0)
    return services.withColumns({
        "ci_servico": F.when(done, F.col("consumidores")).otherwise(F.lit(0)),
        "chi_servico": F.when(done, F.col("consumidores") * hours).otherwise(F.lit(0.0)),
        "verificar_termino": F.coalesce(done & F.col("fim").isNull(), F.lit(False)),
    })


def context_blocks(rows: DataFrame, context: list[str], seq: str, ini: str = "inicio", fim: str = "fim") -> DataFrame:
    """Temporal blocks of rows with the same context, with leader and consolidated window."""
    return temporal_blocks(rows, context, seq, ini, fim)


def distance_to_history(rows: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """Z-score of each feature within its group and the Euclidean length of the z vector."""
    stats = rows.groupBy(*group).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_samp(f).alias(f"_s_{f}") for f in features]
    )
    out = rows.join(stats, group, "left")
    z = {f: F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(0.0)) for f in features}
    out = out.withColumns({f"z_{f}": c for f, c in z.items()})
    total = None
    for f in features:
        square = F.col(f"z_{f}") * F.col(f"z_{f}")
        total = square if total is None else total + square
    return out.withColumn("distancia", F.sqrt(total)).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


def protocol_mixing(rows: DataFrame, key: list[str], protocol: str = "protocolo", ini: str = "inicio", fim: str = "fim") -> DataFrame:
    """Protocol-0 rows that overlap a protocol-1 or protocol-6 row of the same device."""
    return overlaps_any(
        rows.where(F.col(protocol) == "0"), rows.where(F.col(protocol).isin("1", "6")), key, ini, fim, "_mix"
    ).where("_mix").drop("_mix")


def short_beside_long(rows: DataFrame, key: list[str], minutes: str = "duracao_min", ini: str = "inicio", fim: str = "fim") -> DataFrame:
    """Short rows that coincide with a long row of the same key (which includes the protocol)."""
    return overlaps_any(rows.where(F.col(minutes) < 3), rows.where(F.col(minutes) >= 3), key, ini, fim, "_hit").where("_hit").drop("_hit")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Additions, removals and changed fields between two snapshots, one row per (key, field)."""
    a = old.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    b = new.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_b"))
    both = a.join(b, key, "full_outer")
    entry = lambda f: F.when(
        ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")),
        F.struct(F.lit(f).alias("campo"), F.col(f"_a.{f}").alias("valor_anterior"), F.col(f"_b.{f}").alias("valor_atual")),
    )
    changed = F.array_compact(F.array(*[entry(f) for f in fields]))
    whole = lambda label: F.array(F.struct(F.lit("*").alias("campo"), F.lit(None).cast("string").alias("valor_anterior"),
                                           F.lit(None).cast("string").alias("valor_atual")))
    kind = F.when(F.col("_a").isNull(), F.lit("INCLUSAO")).when(F.col("_b").isNull(), F.lit("EXCLUSAO")).otherwise(F.lit("ALTERACAO"))
    rows = both.withColumn("tipo_alteracao", kind).withColumn(
        "_e", F.explode(F.when(F.col("tipo_alteracao") == "ALTERACAO", changed).otherwise(whole("*")))
    )
    return rows.select(*key, "tipo_alteracao", "_e.campo", "_e.valor_anterior", "_e.valor_atual")


def effect_of_proposal(original: DataFrame, proposed: DataFrame, effective: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Original, proposed and effective value of each field of proposed records, and the outcome per record.

    ``IGUAL`` all fields took effect, ``DIVERGENTE`` none, ``PARCIALMENTE_EFETIVADO`` some, ``NAO_ENCONTRADO`` no record.
    """
    side = lambda df, p: df.select(*key, F.lit(True).alias(f"_{p}"), *[F.col(f).cast("string").alias(f"{f}_{p}") for f in fields])
    rows = side(proposed, "proposto").join(side(original, "original"), key, "left").join(side(effective, "efetivado"), key, "left")
    hits = sum((F.col(f"{f}_proposto").eqNullSafe(F.col(f"{f}_efetivado")).cast("int") for f in fields), F.lit(0))
    outcome = (
        F.when(F.col("_efetivado").isNull(), F.lit("NAO_ENCONTRADO")).when(hits == len(fields), F.lit("IGUAL"))
        .when(hits == 0, F.lit("DIVERGENTE")).otherwise(F.lit("PARCIALMENTE_EFETIVADO"))
    )
    return rows.withColumn("resultado", outcome).drop("_original", "_proposto", "_efetivado")


def equipment_signature(rows: DataFrame, group: list[str], cause: str, minutes: str, event: str) -> DataFrame:
    """Typical behaviour of equipment: events, most frequent cause, mean and longest duration, event rate per day."""
    base = rows.groupBy(*group).agg(
        F.countDistinct(event).alias("eventos"), F.avg(minutes).alias("duracao_media"), F.max(minutes).alias("duracao_max"),
        F.countDistinct(F.to_date("inicio")).alias("dias_com_evento"),
    )
    usual = mode_per_group(rows, group, cause, "causa_tipica").withColumnRenamed("ocorrencias", "ocorrencias_causa")
    return base.join(usual, group, "left").withColumn("reincidencia", F.col("eventos") / F.col("dias_com_evento"))


def protocol_minimum(rows: DataFrame, protocol: str, chi: str, minimum: float = MIN_ISE_CHI) -> DataFrame:
    """Customer hours per protocol against the minimum, ranked by what is missing."""
    total = rows.groupBy(protocol).agg(F.sum(chi).alias("chi_total"), F.count("*").alias("eventos"))
    return total.withColumns({
        "atinge_minimo": F.col("chi_total") >= minimum, "faltante": F.greatest(F.lit(minimum) - F.col("chi_total"), F.lit(0.0)),
    })


def protocol_candidates(rows: DataFrame, group: str, chi: str, n: int, ties: tuple = ()) -> DataFrame:
    """Events to add to a protocol, by customer hours, with the mandatory-review mark."""
    return top_n(rows, [group], [F.desc_nulls_last(chi), *[F.asc(c) for c in ties]], n).withColumn(
        "revisao_obrigatoria", F.col(chi) >= REVIEW_CHI
    )


def complaints(rows: DataFrame, group: list[str], uc: str = "uc", moment: str = "momento") -> DataFrame:
    """Per group and day: complaints, and UCs with exactly two, exactly three and more complaints."""
    per_uc = rows.groupBy(*group, F.to_date(moment).alias("dia"), uc).agg(F.count("*").alias("n"))
    hit = lambda c: F.sum(c.cast("long"))
    return per_uc.groupBy(*group, "dia").agg(
        F.sum("n").alias("qtd_reclamacoes"), F.count(uc).alias("qtd_ucs"), hit(F.col("n") == 2).alias("qtd_uc_com_2_reclamacoes"),
        hit(F.col("n") == 3).alias("qtd_uc_com_3_reclamacoes"), hit(F.col("n") > 3).alias("qtd_uc_com_mais_de_3_reclamacoes"),
    )


def topology_coverage(rows: DataFrame, topology: DataFrame, group: list[str], uc: str = "uc") -> DataFrame:
    """Share of complaints whose UC has a topology row (``topology``: one row per UC)."""
    marked = rows.join(topology.select(uc).withColumn("_t", F.lit(1)), uc, "left")
    return marked.groupBy(*group).agg(F.count("*").alias("reclamacoes"), F.count("_t").alias("com_topologia")).withColumn(
        "cobertura", F.col("com_topologia") / F.col("reclamacoes")
    )


def latest_topology(rows: DataFrame, uc: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per UC as one aggregate with partial maxima: no ranking of the whole base."""
    best = F.max(F.struct(*[F.col(c).alias(c) for c in [*order, *[c for c in columns if c not in order]]])).alias("_b")
    return rows.groupBy(uc).agg(best).select(uc, *[F.col(f"_b.{c}").alias(c) for c in columns])


def suggest_codes(missing: DataFrame, history: DataFrame, group: list[str], code: str) -> DataFrame:
    """Most frequent code of similar records (same group) for records without one."""
    return missing.join(mode_per_group(history, group, code, f"{code}_sugerido"), group, "left")
