"""Data quality: issue queue, overlap analyses, treatment, outliers, summaries, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import (
    MAX_SEQ, blank_to_null, event_number, int_or, is_blank, num_br, record_key, text,
)
from ..functions.time import dmy_text, iso_text, minute_boundaries, parse_ts, plus_hours
from ..operators.intervals import best_container, contained, overlap_pairs, overlaps_other, trim_partial
from ..operators.overlaps import overlap_counts, pairs_of
from ..operators.relational import first_per_key, stack
from ..session import materialize


def _ini(df: DataFrame) -> Column:
    return F.col("DATA_HORA_INIC_INTRP_TS") if "DATA_HORA_INIC_INTRP_TS" in df.columns else parse_ts("DATA_HORA_INIC_INTRP")


def _fim(df: DataFrame) -> Column:
    return F.col("DATA_HORA_FIM_INTRP_TS") if "DATA_HORA_FIM_INTRP_TS" in df.columns else parse_ts("DATA_HORA_FIM_INTRP")


def _ini_uc(df: DataFrame) -> Column:
    return F.col("DTHR_INICIO_INTRP_UC_TS") if "DTHR_INICIO_INTRP_UC_TS" in df.columns else parse_ts("DTHR_INICIO_INTRP_UC")


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long"))


def protocol(col: str = "TIPO_PROTOC_JUSTIF_UCI") -> Column:
    return F.coalesce(blank_to_null(col), F.lit(S.NO_PROTOCOL))


# ----------------------------------------------------------------------------------- event roll-ups


def negative_events(df: DataFrame, duration_min: int | None = None, duration_max: int | None = None,
                    whole_minutes: bool = False) -> DataFrame:
    """Events that end before they start, one row each, with the number of rows behind them.

    ``whole_minutes`` asks for at least one minute mark in between, as the listings do; the queue does not.
    """
    rows = df.withColumns({"_ini": _ini(df), "_fim": _fim(df), "num_seq": event_number(df)})
    rows = rows.withColumn("_min", minute_boundaries("_ini", "_fim")).where(
        (F.col("_fim") < F.col("_ini")) & F.col("num_seq").isNotNull()
    )
    if whole_minutes:
        rows = rows.where(F.col("_min") < 0)
    if duration_min is not None:
        rows = rows.where(F.col("_min") >= duration_min)
    if duration_max is not None:
        rows = rows.where(F.col("_min") <= duration_max)
    extra = [c for c in ("ANOMES_PROCESSAMENTO", "NUM_OCORRENCIA_ADMS") if c in df.columns]
    return rows.groupBy("num_seq").agg(
        F.min("_ini").alias("inicio"), F.min("_fim").alias("fim"), F.min("_min").alias("duracao_minutos"),
        F.max(text("NUM_OPER_CHV_INTRP")).alias("num_oper_chv_intrp"),
        F.max(text("REGIONAL_ORIGEM")).alias("regional_origem"), *[F.max(c).alias(c) for c in extra],
        F.count("*").alias("qtd_ucs_afetadas"),
    )


def device_events(df: DataFrame) -> DataFrame:
    """Events per device: first start, last end, order number, rows."""
    rows = df.withColumns({"_ini": _ini(df), "_fim": _fim(df), "num_seq": event_number(df)}).where(
        blank_to_null("NUM_OPER_CHV_INTRP").isNotNull() & F.col("_ini").isNotNull() & F.col("_fim").isNotNull()
        & F.col("num_seq").isNotNull()
    )
    return rows.groupBy(text("NUM_OPER_CHV_INTRP").alias("device"), "num_seq").agg(
        F.min("_ini").alias("inicio"), F.max("_fim").alias("fim"),
        F.coalesce(F.min(int_or("NUM_SEQ_INTRP")), F.lit(MAX_SEQ)).alias("ordem"),
        F.max(text("REGIONAL_ORIGEM")).alias("regional_origem"), F.count("*").alias("qtd_ucs_afetadas"),
    )


def device_pairs(events: DataFrame) -> DataFrame:
    """Each unordered pair of overlapping events of a device, oriented: kept (lower number) and rejected.

    Events with the same order number keep both, so such pairs do not appear.
    """
    pairs = overlap_pairs(
        events, ["device"], "num_seq", ["ordem", "regional_origem", "qtd_ucs_afetadas"]
    ).where(F.col("a_ordem") != F.col("b_ordem"))
    a_kept = F.col("a_ordem") < F.col("b_ordem")
    names = ["num_seq", "inicio", "fim", "regional_origem", "qtd_ucs_afetadas"]
    pick = lambda first, n: F.when(first, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}"))
    return pairs.select(
        "device", *[pick(~a_kept, n).alias(n) for n in names],
        pick(a_kept, "num_seq").alias("num_seq_sobreposta"), pick(a_kept, "inicio").alias("inicio_sobreposta"),
        pick(a_kept, "fim").alias("fim_sobreposta"),
    )


def device_overlaps(events: DataFrame) -> DataFrame:
    """Events to reject, one row each: how many events of the device with a lower order number they overlap, and which ends last.

    No pairs are listed; ``device_pairs_of`` lists those of a page.
    """
    numbered = events.withColumn("_n", F.nullif(F.col("ordem"), F.lit(MAX_SEQ)))
    return overlap_counts(numbered, ["device"], "_n", "num_seq").drop("_n")


def device_pairs_of(page: DataFrame, events: DataFrame) -> DataFrame:
    """The pairs of the events of a page of ``device_overlaps``, in the columns of ``device_pairs``."""
    pairs = pairs_of(page, events.where(F.col("ordem") < MAX_SEQ), ["device"], "ordem", "num_seq")
    return pairs.select("device", "num_seq", "inicio", "fim", "regional_origem", "qtd_ucs_afetadas", "num_seq_sobreposta", "inicio_sobreposta", "fim_sobreposta")


def overlapped_event_count(df: DataFrame) -> DataFrame:
    """Number of distinct events that overlap another event of their device."""
    marked = overlaps_other(device_events(df), ["device"]).where("sobrepoe").select("num_seq").distinct()
    return marked.agg(F.count("*").alias("sobreposicao_interrupcao"))


def uc_events(df: DataFrame) -> DataFrame:
    """Eligible UC rows per (record key, event, protocol)."""
    rows = df.withColumns({"_ini": _ini_uc(df), "_fim": _fim(df), "num_seq": event_number(df), "protocolo": protocol()})
    rows = rows.where(
        (text("ESTADO_INTRP") == S.STATE_ELIGIBLE) & is_blank("NUM_MOTIVO_TRAT_DIF_UCI")
        & blank_to_null("NUM_UC_UCI").isNotNull() & (F.col("_fim") >= F.col("_ini")) & F.col("num_seq").isNotNull()
    )
    return rows.groupBy(*[text(c).alias(c) for c in S.RECORD_KEY], "num_seq", "protocolo").agg(
        F.min("_ini").alias("inicio"), F.max("_fim").alias("fim"),
        F.max(text("REGIONAL_ORIGEM")).alias("regional_origem"),
    )


def uc_contained(df: DataFrame) -> DataFrame:
    """UC rows contained in another event of the same UC and protocol, with the best container."""
    rows = materialize(uc_events(df).withColumn("_o", int_or("num_seq", MAX_SEQ)), "registros")  # read for sizes of keys and for rows
    return best_container(rows, ["NUM_UC_UCI", "protocolo"], "num_seq", "_o").where(
        F.col("evento_contem").isNotNull()
    )


# ---------------------------------------------------------------------------------------- the queue


def suggested_end(base: str = "inicio") -> Column:
    """Suggested end for a gap of at most three hours: ``base`` (start or end) plus three hours."""
    return F.when(F.col("duracao_minutos") >= -180, dmy_text(plus_hours(base, 3)))


def _issue(df: DataFrame, run_ts: str, **columns) -> DataFrame:
    values = {"status_pendencia": F.lit("pendente"), "criado_em": F.lit(run_ts), **columns}
    return df.select(*[
        values.get(c, F.lit(None)).cast("string").alias(c) for c in S.ISSUE_COLUMNS
    ])


def event_facts(df: DataFrame) -> DataFrame:
    """One row per event and device with what each event rule needs: negative time, overlap on the device, missing codes.

    The facts of a rule are over the rows it concerns, ``n_<rule>`` of them.
    """
    rows = df.withColumns({"_ini": _ini(df), "_fim": _fim(df), "num_seq": event_number(df)}).where(F.col("num_seq").isNotNull())
    device, area = text("NUM_OPER_CHV_INTRP"), text("REGIONAL_ORIGEM")
    negative = F.col("_fim") < F.col("_ini")
    placed = blank_to_null("NUM_OPER_CHV_INTRP").isNotNull() & F.col("_ini").isNotNull() & F.col("_fim").isNotNull()
    missing = is_blank("COD_CAUSA_INTRP") | is_blank("COD_COMP_INTRP")
    return rows.groupBy("num_seq", device.alias("device")).agg(
        F.count_if(negative).alias("n_neg"), F.min(F.when(negative, F.col("_ini"))).alias("neg_ini"), F.min(F.when(negative, F.col("_fim"))).alias("neg_fim"),
        F.min(F.when(negative, minute_boundaries("_ini", "_fim"))).alias("neg_min"), F.max(F.when(negative, area)).alias("neg_area"),
        F.count_if(placed).alias("n_dev"), F.min(F.when(placed, F.col("_ini"))).alias("inicio"), F.max(F.when(placed, F.col("_fim"))).alias("fim"),
        F.coalesce(F.min(F.when(placed, int_or("NUM_SEQ_INTRP"))), F.lit(MAX_SEQ)).alias("ordem"), F.max(F.when(placed, area)).alias("dev_area"),
        F.count_if(missing).alias("n_cod"), F.max(F.when(missing, text("COD_CAUSA_INTRP"))).alias("cod_causa"),
        F.max(F.when(missing, text("COD_COMP_INTRP"))).alias("cod_comp"), F.max(F.when(missing, area)).alias("cod_area"),
    )


def issue_queue(df: DataFrame, run_ts: str, suggest_base: str = "inicio") -> DataFrame:
    """The four rules as one queue of 18 text columns.

    Negative time and missing codes are one row per event, UC overlap one row per contained record. Device overlap is as many
    equal rows per rejected event as it overlaps events, as published: they are counted and repeated, not paired. The three
    event rules share one stored roll-up of the stage.
    """
    seq = F.col("num_seq")
    facts = materialize(event_facts(df), "fatos")
    negative_rows = facts.where("n_neg > 0").groupBy("num_seq").agg(
        F.min("neg_ini").alias("inicio"), F.min("neg_fim").alias("fim"), F.min("neg_min").alias("duracao_minutos"),
        F.max("device").alias("num_oper_chv_intrp"), F.max("neg_area").alias("regional_origem"), F.sum("n_neg").alias("qtd_ucs_afetadas"))
    device_rows = facts.where("n_dev > 0").select(
        "device", "num_seq", "inicio", "fim", "ordem", F.col("dev_area").alias("regional_origem"), F.col("n_dev").alias("qtd_ucs_afetadas"))
    code_rows = facts.where("n_cod > 0").groupBy("num_seq").agg(
        F.max("device").alias("num_oper_chv_intrp"), F.max("cod_area").alias("regional_origem"), F.max("cod_causa").alias("cod_causa"),
        F.max("cod_comp").alias("cod_comp"), F.sum("n_cod").alias("qtd_ucs_afetadas"))
    negative = _issue(
        negative_rows, run_ts, regra=F.lit("horario_negativo"), gravidade=F.lit("alta"),
        grao=F.lit("NUM_SEQ_INTRP"), chave_evento=seq, chave_registro=seq, num_seq_intrp=seq,
        num_oper_chv_intrp=F.col("num_oper_chv_intrp"), regional_origem=F.col("regional_origem"),
        campo_sugerido=F.lit("DATA_HORA_FIM_INTRP"), valor_original=dmy_text("fim"),
        valor_sugerido=suggested_end(suggest_base),
        acao_sugerida=F.when(F.col("duracao_minutos") >= -180, F.lit("corrigir_fuso")).otherwise(F.lit("revisao_manual")),
        justificativa_sistema=F.concat(F.lit(S.MSG_NEGATIVE), text("qtd_ucs_afetadas")),
    )
    repeated = device_overlaps(device_rows).withColumn("_", F.explode(F.sequence(F.lit(1), "sobrepostas")))
    device_key = F.concat(F.col("device"), F.lit("|"), seq)
    device = _issue(
        repeated, run_ts, regra=F.lit("sobreposicao_interrupcao"), gravidade=F.lit("alta"),
        grao=F.lit("NUM_OPER_CHV_INTRP|NUM_SEQ_INTRP"), chave_evento=device_key, chave_registro=device_key,
        num_seq_intrp=seq, num_oper_chv_intrp=F.col("device"), regional_origem=F.col("regional_origem"),
        campo_sugerido=F.lit("NUM_MOTIVO_TRAT_DIF_UCI"), valor_sugerido=F.lit(S.REASON_OVERLAP),
        acao_sugerida=F.lit("sugerir_rejeitar"),
        justificativa_sistema=F.concat(F.lit(S.MSG_DEVICE), text("qtd_ucs_afetadas")),
    )
    uc = _issue(
        uc_contained(df), run_ts, regra=F.lit("sobreposicao_uc"), gravidade=F.lit("alta"),
        grao=F.lit("NUM_UC_UCI|NUM_SEQ_INTRP"),
        chave_evento=F.concat(F.col("NUM_UC_UCI"), F.lit("|"), seq), chave_registro=record_key(),
        num_seq_intrp=seq, num_intrp_uci=F.col("NUM_INTRP_UCI"), num_posto_uci=F.col("NUM_POSTO_UCI"),
        num_uc_uci=F.col("NUM_UC_UCI"), regional_origem=F.col("regional_origem"),
        campo_sugerido=F.lit("NUM_MOTIVO_TRAT_DIF_UCI"), valor_sugerido=F.lit(S.REASON_OVERLAP),
        acao_sugerida=F.lit("classificar_91"),
        justificativa_sistema=F.concat(F.lit(S.MSG_UC), F.col("evento_contem")),
    )
    codes = _issue(
        code_rows, run_ts, regra=F.lit("sem_causa_componente"), gravidade=F.lit("media"),
        grao=F.lit("NUM_SEQ_INTRP"), chave_evento=seq, chave_registro=seq, num_seq_intrp=seq,
        num_oper_chv_intrp=F.col("num_oper_chv_intrp"), regional_origem=F.col("regional_origem"),
        campo_sugerido=F.when(is_blank("cod_causa"), F.lit("COD_CAUSA_INTRP")).otherwise(F.lit("COD_COMP_INTRP")),
        acao_sugerida=F.lit("sugerir_por_historico_iqs"),
        justificativa_sistema=F.concat(F.lit(S.MSG_CODES), text("qtd_ucs_afetadas")),
    )
    return stack(negative, device, uc, codes)


def queue_summary(queue: DataFrame) -> DataFrame:
    """Rows and distinct records per rule and status."""
    return queue.groupBy("regra", "status_pendencia").agg(
        F.count("*").alias("total"), F.countDistinct("chave_registro").alias("registros")
    )


def queue_order(queue: DataFrame) -> list[Column]:
    """Listing order by what the queue has: priority, severity (as text, descending), rule, key."""
    order = []
    if "prioridade" in queue.columns:
        order.append(F.asc_nulls_last("prioridade"))
    if "gravidade" in queue.columns:
        order.append(F.desc_nulls_last("gravidade"))
    order += [F.asc_nulls_last(c) for c in ("regra", "chave_evento", "chave_registro", "justificativa_sistema")
              if c in queue.columns]
    return order


# --------------------------------------------------------------------------------- device containment


def device_containment(df: DataFrame, anomes: str) -> DataFrame:
    """Keep/exclude analysis of eligible device events (a missing number counts as 0)."""
    rows = df.withColumns({"_ini": _ini(df), "_fim": _fim(df)}).where(
        (text("TIPO_EQP_INTRP") == "C") & (text("ESTADO_INTRP") == S.STATE_ELIGIBLE)
        & is_blank("NUM_MOTIVO_TRAT_DIF_UCI") & blank_to_null("NUM_OPER_CHV_INTRP").isNotNull()
        & F.col("NUM_SEQ_INTRP").isNotNull() & F.col("_ini").isNotNull() & F.col("_fim").isNotNull()
    )
    carried = {
        "COD_CAUSA_INTRP": "COD_CAUSA_INTRP", "COD_COMP_INTRP": "COD_COMP_INTRP", "COD_TIPO_INTRP": "COD_TIPO_INTRP",
        "TIPO_PROTOC_JUSTIF_INTRP": "TIPO_PROTOC_JUSTIF_INTRP", "TIPO_PROTOC_JUSTIF_UCI": "TIPO_PROTOC_JUSTIF_UCI",
        "REGIONAL_ORIGEM": "REGIONAL_ORIGEM",
    }
    events = rows.groupBy(
        F.coalesce(text("NUM_OCORRENCIA_ADMS"), text("PID_INTRP_CONJTO_PIN")).alias("ocorrencia"),
        text("NUM_SEQ_INTRP").alias("interrupcao"), text("TIPO_CHV_INTRP").alias("tipo_chave"),
        text("NUM_OPER_CHV_INTRP").alias("NUMERO_OPERACIONAL"),
    ).agg(
        F.min("_ini").alias("DATA_INICIO"), F.max("_fim").alias("DATA_FIM"),
        *[F.max(text(c)).alias(n) for n, c in carried.items()],
        F.countDistinct(
            F.coalesce(text("NUM_POSTO_UCI"), F.lit("")), F.coalesce(text("NUM_UC_UCI"), F.lit(""))
        ).alias("UC_AFETADAS"),
    )
    # One narrow row per event, read several times below: stored once instead of grouping all rows again.
    events = materialize(events, "eventos")
    # Nothing here keeps an event whose last end precedes its first start, so the search allows for it.
    judged = contained(
        events.withColumn("_o", int_or("interrupcao", 0)), ["NUMERO_OPERACIONAL"], "interrupcao", "_o", "DATA_INICIO",
        "DATA_FIM",
    ).drop("_o")
    out = F.col("contido")
    return judged.select(
        F.lit(anomes).alias("anomes"), "NUMERO_OPERACIONAL", "ocorrencia", "interrupcao", "tipo_chave", "DATA_INICIO",
        "DATA_FIM",
        F.when(out, F.lit("EXCLUIR (Contido em outra)")).otherwise(F.lit("MANTER (OK)")).alias("SITUACAO"),
        F.when(out, F.lit("EXCLUIR")).otherwise(F.lit("MANTER")).alias("acao_sugerida"),
        F.when(out, F.lit(S.STATE_CANCELLED)).alias("ESTADO_INTRP_SUGERIDO"),
        F.when(out, F.lit(S.REASON_OVERLAP)).alias("NUM_MOTIVO_TRAT_DIF_UCI_SUGERIDO"),
        *carried, "UC_AFETADAS",
        F.when(out, F.lit(S.MSG_CONTAINED)).otherwise(F.lit(S.MSG_NOT_CONTAINED)).alias("JUSTIFICATIVA_SISTEMA"),
    )


def containment_summary(analysis: DataFrame) -> DataFrame:
    return analysis.agg(
        F.count("*").alias("total_interrupcoes"), _count(F.col("acao_sugerida") == "MANTER").alias("manter"),
        _count(F.col("acao_sugerida") == "EXCLUIR").alias("excluir"),
    )


# ------------------------------------------------------------------------------------- UC containment


def _uc_rows(df: DataFrame, seq: Column) -> DataFrame:
    return df.withColumns({
        "_ini": _ini_uc(df), "_fim": _fim(df), "chave_registro": record_key(), "protocolo": protocol(),
        "num_seq_intrp": seq,
    }).where(
        (text("ESTADO_INTRP") == S.STATE_ELIGIBLE) & is_blank("NUM_MOTIVO_TRAT_DIF_UCI")
        & blank_to_null("NUM_UC_UCI").isNotNull() & F.col("_ini").isNotNull() & F.col("_fim").isNotNull()
    )


def uc_containment(df: DataFrame, anomes: str, run_ts: str) -> DataFrame:
    """Records to classify 91: contained in another event of the same UC and protocol, with hours and impact.

    A missing event number sorts last among ties. Records without an event number take no part.
    """
    rows = _uc_rows(df, text("NUM_SEQ_INTRP")).where((F.col("_fim") >= F.col("_ini")) & F.col("num_seq_intrp").isNotNull()).select(
        "num_seq_intrp", text("NUM_INTRP_UCI").alias("num_intrp_uci"),
        text("NUM_POSTO_UCI").alias("num_posto_uci"), text("NUM_UC_UCI").alias("num_uc_uci"), "protocolo",
        text("REGIONAL_ORIGEM").alias("regional_origem"), F.coalesce(num_br("KVA_INTRP"), F.lit(0.0)).alias("kva_intrp"),
        F.col("_ini").alias("inicio"), F.col("_fim").alias("fim"), int_or("num_seq_intrp", MAX_SEQ).alias("_o"),
    )
    found = best_container(rows, ["num_uc_uci", "protocolo"], "num_seq_intrp", "_o").where(
        F.col("evento_contem").isNotNull()
    )
    hours = F.col("duracao_minutos") / F.lit(60.0)
    # The record key is put together here, of columns that moved anyway.
    return found.withColumn("duracao_minutos", minute_boundaries("inicio", "fim")).select(
        F.lit(anomes).alias("anomes"), record_key("num_intrp_uci", "num_posto_uci", "num_uc_uci").alias("chave_registro"), "num_seq_intrp", F.col("evento_contem").alias("num_seq_contem"),
        "num_intrp_uci", "num_posto_uci", "num_uc_uci", "protocolo", "regional_origem",
        iso_text("inicio").alias("data_inicio_uc"), iso_text("fim").alias("data_fim_uc"),
        iso_text("inicio_contem").alias("data_inicio_contem"), iso_text("fim_contem").alias("data_fim_contem"),
        "duracao_minutos", F.round(hours, 6).alias("horas_uc_reduzidas"), "kva_intrp",
        F.round(hours * F.col("kva_intrp"), 6).alias("chi_reduzido_estimado"),
        F.lit("NUM_MOTIVO_TRAT_DIF_UCI").alias("campo_sugerido"), F.lit(S.REASON_OVERLAP).alias("valor_sugerido"),
        F.lit("CLASSIFICAR_91").alias("acao_sugerida"), F.lit("pendente").alias("status_pendencia"),
        F.lit(S.MSG_UC_CONTAINED).alias("justificativa_sistema"), F.lit(run_ts).alias("criado_em"),
    )


def uc_containment_summary(analysis: DataFrame) -> DataFrame:
    return analysis.agg(
        F.count("*").alias("registros_classificar_91"), F.countDistinct("num_uc_uci").alias("ucs_afetadas"),
        F.countDistinct("num_seq_intrp").alias("interrupcoes_afetadas"),
        F.coalesce(F.sum("horas_uc_reduzidas"), F.lit(0.0)).alias("horas_uc_reduzidas"),
        F.coalesce(F.sum("chi_reduzido_estimado"), F.lit(0.0)).alias("chi_reduzido_estimado"),
    )


def uc_trim(df: DataFrame, run_ts: str) -> DataFrame:
    """Records that start inside an earlier record of the same UC and protocol and outlast it: start moves to
    the predecessor's end."""
    rows = _uc_rows(df, blank_to_null("NUM_SEQ_INTRP")).where(F.col("chave_registro").isNotNull()).select(
        "chave_registro", "num_seq_intrp", blank_to_null("NUM_INTRP_UCI").alias("num_intrp_uci"),
        blank_to_null("NUM_UC_UCI").alias("num_uc_uci"), text("NUM_POSTO_UCI").alias("num_posto_uci"),
        F.col("protocolo").alias("protocolo_uc"), F.col("_ini").alias("inicio"), F.col("_fim").alias("fim"),
        int_or("num_seq_intrp", MAX_SEQ).alias("_o"),
    )
    found = trim_partial(
        rows, ["num_uc_uci", "protocolo_uc"], ["_o", F.coalesce("num_seq_intrp", F.lit("\uffff")), "num_intrp_uci"],
        origin={"num_seq_intrp_origem": "num_seq_intrp", "num_intrp_uci_origem": "num_intrp_uci"},
    )
    end = iso_text("fim_origem")
    return found.select(
        F.lit("sobreposicao_uc_fase2_interseccao").alias("regra"), "chave_registro",
        F.col("num_intrp_uci").alias("num_intrp_uci_alvo"), F.col("num_seq_intrp").alias("num_seq_intrp_alvo"),
        "num_uc_uci", "num_posto_uci", "protocolo_uc", iso_text("inicio").alias("inicio_original"),
        iso_text("fim").alias("fim_alvo"), "num_intrp_uci_origem", "num_seq_intrp_origem",
        iso_text("inicio_origem").alias("inicio_origem"), end.alias("inicio_sugerido"), end.alias("fim_origem"),
        "minutos_interseccao", F.lit("DTHR_INICIO_INTRP_UC").alias("campo_sugerido"), end.alias("valor_sugerido"),
        F.lit("NUM_INTRP_INIC_MANOBRA_UCI").alias("campo_manobra_sugerido"),
        F.col("num_seq_intrp_origem").alias("valor_manobra_sugerido"),
        F.lit("AJUSTAR_INICIO_MANOBRA_UC").alias("acao_sugerida"), F.lit(S.MSG_UC_TRIM).alias("justificativa_sistema"),
        F.lit("pendente").alias("status_pendencia"), F.lit(run_ts).alias("criado_em"),
    )


def uc_trim_summary(analysis: DataFrame) -> DataFrame:
    return analysis.agg(
        F.count("*").alias("total_ajustes"), F.countDistinct("num_uc_uci").alias("ucs_afetadas"),
        F.countDistinct("num_seq_intrp_alvo").alias("interrupcoes_ajustadas"),
        F.coalesce(F.sum("minutos_interseccao"), F.lit(0)).alias("minutos_interseccao"),
    )


# ------------------------------------------------------------------------------------------ treatment


def treatment_flags(df: DataFrame, excluded_events: DataFrame) -> DataFrame:
    """Add the three removal flags.

    They keep SQL's three-valued logic: an unreadable time leaves the first flag null, and a row with a null
    flag and no true one is neither treated nor logged.
    """
    marker = excluded_events.select(text("NUM_SEQ_INTRP").alias("_seq")).where(
        F.col("_seq").isNotNull()
    ).distinct().withColumn("_hit", F.lit(True))
    rows = df.withColumn("_seq", text("NUM_SEQ_INTRP")).join(marker, "_seq", "left")
    listed = F.when(F.col("_seq").isNotNull(), F.coalesce("_hit", F.lit(False)))
    return rows.withColumns({
        "flag_horario_negativo": _fim(df) < _ini(df),
        "flag_sem_causa_componente": is_blank("COD_CAUSA_INTRP") | is_blank("COD_COMP_INTRP"),
        "flag_sobreposicao_interrupcao": listed & (text("ESTADO_INTRP") == S.STATE_ELIGIBLE)
        & is_blank("NUM_MOTIVO_TRAT_DIF_UCI"),
    }).drop("_seq", "_hit")


FLAGS = ["flag_horario_negativo", "flag_sem_causa_componente", "flag_sobreposicao_interrupcao"]


def excluded_events(analysis: DataFrame) -> DataFrame:
    return analysis.where(F.col("acao_sugerida") == "EXCLUIR").select(F.col("interrupcao").alias("NUM_SEQ_INTRP"))


def treated(flagged: DataFrame) -> DataFrame:
    keep = ~F.col(FLAGS[0]) & ~F.col(FLAGS[1]) & ~F.col(FLAGS[2])
    return flagged.where(keep).drop(*FLAGS)


def removal_log(flagged: DataFrame, anomes: str, run_ts: str) -> DataFrame:
    """One row per (row, violated rule), in one pass over the flags."""
    entry = lambda flag, rule, why: F.when(
        F.col(flag), F.struct(F.lit(rule).alias("regra"), F.lit(why).alias("justificativa"))
    )
    entries = F.array_compact(F.array(
        entry(FLAGS[0], "horario_negativo", S.MSG_REMOVED_NEGATIVE),
        entry(FLAGS[1], "sem_causa_componente", S.MSG_REMOVED_CODES),
        entry(FLAGS[2], "sobreposicao_interrupcao", S.MSG_REMOVED_OVERLAP),
    ))
    names = ["NUM_SEQ_INTRP", *S.RECORD_KEY, "REGIONAL_ORIGEM"]
    return flagged.withColumn("_e", F.explode(entries)).select(
        F.lit(anomes).alias("anomes"), F.lit(run_ts).alias("executado_em"), *[text(c).alias(c) for c in names],
        F.col("_e.regra").alias("regra"), F.lit("remover_csv_iqs").alias("acao"),
        F.col("_e.justificativa").alias("justificativa"),
    )


def treatment_counters(flagged: DataFrame) -> DataFrame:
    """One row; ``removido_tempo_nulo`` counts the rows that leave without a log entry."""
    f = [F.col(c) for c in FLAGS]
    kept = F.coalesce(~f[0] & ~f[1] & ~f[2], F.lit(False))
    logged = F.coalesce(f[0], F.lit(False)) | F.coalesce(f[1], F.lit(False)) | F.coalesce(f[2], F.lit(False))
    return flagged.agg(
        F.count("*").alias("total_original"), _count(f[0]).alias("removido_horario_negativo"),
        _count(f[1]).alias("removido_sem_causa_componente"), _count(f[2]).alias("removido_sobreposicao_interrupcao"),
        _count(~kept & ~logged).alias("removido_tempo_nulo"), _count(kept).alias("total_final"),
    )


# -------------------------------------------------------------------------- outliers, stage summary


def duration_outliers(df: DataFrame, run_ts: str, limit_hours: float = 48.0) -> DataFrame:
    """Events at least ``limit_hours`` long, with the largest value of each event attribute."""
    have = set(df.columns)
    rows = df.where(F.col("NUM_SEQ_INTRP").isNotNull()).withColumns({"_ini": _ini(df), "_fim": _fim(df)}).where(
        F.col("_fim") >= F.col("_ini")
    )
    carried = [c for c in S.EVENT_COLUMNS if c != "NUM_SEQ_INTRP"]
    events = rows.groupBy(text("NUM_SEQ_INTRP").alias("NUM_SEQ_INTRP")).agg(
        *[(F.max(text(c)) if c in have else F.lit(None).cast("string")).alias(c) for c in carried],
        F.min("_ini").alias("inicio_interrupcao_ts"), F.max("_fim").alias("fim_interrupcao_ts"),
        F.countDistinct(blank_to_null("NUM_UC_UCI")).alias("qtd_ucs_afetadas"), F.count("*").alias("qtd_registros_uci"),
    )
    minutes = minute_boundaries("inicio_interrupcao_ts", "fim_interrupcao_ts")
    hours = minutes / F.lit(60.0)
    return events.where(minutes >= int(limit_hours * 60)).withColumns({
        "duracao_horas": F.round(hours, 6),
        "chi_estimado_horas_uc": F.round(hours * F.col("qtd_ucs_afetadas"), 6),
        "regra": F.lit("outlier_duracao_interrupcao"), "acao_sugerida": F.lit("analise_manual"),
        "justificativa_sistema": F.lit(S.MSG_OUTLIER.format(limit_hours)),
        "status_pendencia": F.lit("pendente"), "gerado_em": F.lit(run_ts),
    })


def outlier_summary(outliers: DataFrame) -> DataFrame:
    return outliers.agg(
        F.count("*").alias("total_outliers"), F.coalesce(F.sum("qtd_ucs_afetadas"), F.lit(0)).alias("total_ucs_afetadas"),
        F.coalesce(F.max("duracao_horas"), F.lit(0.0)).alias("duracao_max_horas"),
        F.coalesce(F.sum("chi_estimado_horas_uc"), F.lit(0.0)).alias("chi_estimado_horas_uc"),
    )


def _status(df: DataFrame) -> Column:
    return F.lower(F.trim(text("status_validacao"))) if "status_validacao" in df.columns else F.lit(None).cast("string")


def rejected_by_activity(df: DataFrame) -> DataFrame:
    """Rejected rows per activity, a table of its own whatever the number of activities."""
    activity = text("atividade_validacao") if "atividade_validacao" in df.columns else F.lit(None).cast("string")
    named = F.coalesce(blank_to_null(activity), F.lit("Sem atividade")).alias("atividade")
    return df.where(_status(df) == "rejeitado").groupBy(named).agg(F.count("*").alias("rejeitados"))


def stage_summary(df: DataFrame, anomes: str, run_ts: str, source: str) -> DataFrame:
    """One row of counts over a stage.

    Negative time counts events, missing codes count rows, both as published. Rejected rows per activity, as a JSON object in
    the row, are for a list of activities of the usual length; ``rejected_by_activity`` has them as a table.
    """
    rows = df.withColumn("_status", _status(df))
    base = rows.agg(
        F.count("*").alias("total_registros"),
        _count(is_blank("COD_CAUSA_INTRP") | is_blank("COD_COMP_INTRP")).alias("sem_causa_componente"),
        _count(F.col("_status") == "rejeitado").alias("rejeitados"), _count(F.col("_status") == "validado").alias("validado"),
    )
    negative = negative_events(df).agg(F.count("*").alias("horario_negativo"))
    device = overlapped_event_count(df)
    uc = uc_contained(df).select("num_seq").distinct().agg(F.count("*").alias("sobreposicao_uc"))
    as_json = rejected_by_activity(df).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("atividade", "rejeitados"))))).alias(
        "rejeitados_por_atividade_json"
    ))
    # Every side is a single row by construction (global aggregate), so joining them on a constant is safe.
    parts = [p.withColumn("_one", F.lit(1)) for p in (negative, device, uc, as_json)]
    out = base.withColumn("_one", F.lit(1))
    for part in parts:
        out = out.join(part, "_one")
    pending = F.greatest(F.col("total_registros") - F.col("rejeitados") - F.col("validado"), F.lit(0))
    return out.select(
        F.lit(anomes).alias("anomes"), F.lit(run_ts).alias("gerado_em"), F.lit(source).alias("fonte"), "total_registros",
        pending.alias("pendencias_totais"), "horario_negativo", "sobreposicao_interrupcao", "sobreposicao_uc",
        "sem_causa_componente", "rejeitados", "validado", "rejeitados_por_atividade_json",
    )


# ------------------------------------------------------------------------------------------ listings


def list_negative_events(df: DataFrame, duration_min: int | None = None, duration_max: int | None = None) -> DataFrame:
    """Negative events with a suggested end (start plus three hours)."""
    small = F.col("duracao_minutos") >= -180
    return negative_events(df, duration_min, duration_max, whole_minutes=True).select(
        F.col("num_seq").alias("NUM_SEQ_INTRP"), F.col("num_oper_chv_intrp").alias("NUM_OPER_CHV_INTRP"),
        "NUM_OCORRENCIA_ADMS", dmy_text("inicio").alias("DATA_HORA_INIC_INTRP"), dmy_text("fim").alias("DATA_HORA_FIM_INTRP"),
        "duracao_minutos", "qtd_ucs_afetadas", F.col("regional_origem").alias("REGIONAL_ORIGEM"), "ANOMES_PROCESSAMENTO",
        F.lit("DATA_HORA_FIM_INTRP").alias("CAMPO_SUGERIDO"), suggested_end("inicio").alias("VALOR_SUGERIDO"),
        F.when(small, F.lit(S.MSG_SUGGEST_START)).otherwise(F.lit(S.MSG_MANUAL)).alias("SUGESTAO"),
    )


def list_negative_rows(df: DataFrame) -> DataFrame:
    """Negative rows with a suggested end (end plus three hours)."""
    rows = df.withColumns({"inicio": _ini(df), "fim": _fim(df)})
    rows = rows.withColumn("duracao_minutos", minute_boundaries("inicio", "fim")).where("duracao_minutos < 0")
    small = F.col("duracao_minutos") >= -180
    return rows.select(
        "ANOMES_PROCESSAMENTO", "REGIONAL_ORIGEM", *S.RECORD_KEY, "DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP",
        "duracao_minutos", suggested_end("fim").alias("valor_sugerido"), F.lit("DATA_HORA_FIM_INTRP").alias("campo_sugerido"),
        F.when(small, F.lit(S.MSG_SUGGEST_END)).otherwise(F.lit(S.MSG_MANUAL)).alias("sugestao"),
    )


def largest_gap_first(key: list[str]) -> list[Column]:
    """Listing order of negative rows: the largest gap first, then the key."""
    return [F.desc(F.abs("duracao_minutos")), *[F.asc_nulls_last(c) for c in key]]


def largest_impact_first(listing: DataFrame) -> list[Column]:
    """Listing order of contained records: the largest impact first, then customer and start, then the record."""
    order = [F.desc_nulls_last("chi_reduzido_estimado"), F.asc_nulls_last("num_uc_uci"), F.asc_nulls_last("data_inicio_uc")]
    return order + [F.asc_nulls_last(c) for c in ("chave_registro",) if c in listing.columns]


def first_per_event(page: DataFrame, order: list, event: str = "NUM_SEQ_INTRP", duration: str = "duracao_minutos",
                    shortest: float | None = None, longest: float | None = None) -> DataFrame:
    """The first row of each event of a page in ``order``, of rows whose duration is known and within the bounds."""
    rows = page.where(F.col(duration).isNotNull() & blank_to_null(event).isNotNull())
    rows = rows if shortest is None else rows.where(F.col(duration) >= shortest)
    rows = rows if longest is None else rows.where(F.col(duration) <= longest)
    return first_per_key(rows, [event], order)


def list_device_pairs(df: DataFrame) -> DataFrame:
    """Overlapping events of a device: the event to reject next to the one it overlaps."""
    return device_pairs(device_events(df)).select(
        F.col("device").alias("NUM_OPER_CHV_INTRP"), F.col("num_seq").alias("NUM_SEQ_INTRP"),
        F.col("num_seq_sobreposta").alias("NUM_SEQ_INTRP_SOBREPOSTA"), dmy_text("inicio").alias("DATA_HORA_INIC_INTRP"),
        dmy_text("fim").alias("DATA_HORA_FIM_INTRP"), dmy_text("inicio_sobreposta").alias("DATA_HORA_INIC_SOBREPOSTA"),
        dmy_text("fim_sobreposta").alias("DATA_HORA_FIM_SOBREPOSTA"), "qtd_ucs_afetadas",
        F.lit("sugerir_rejeitar").alias("ACAO_SUGERIDA"), F.lit(S.REASON_OVERLAP).alias("NUM_MOTIVO_TRAT_DIF_UCI_SUGERIDO"),
        F.lit(S.MSG_DEVICE_PAIR).alias("SUGESTAO"),
    )


def _second_of_pair(pairs: DataFrame, first_end: Column, shift: str, short: str, field: str) -> list[Column]:
    long = F.col("segunda_duracao_longa")
    return [
        F.when(long, F.lit(field)).otherwise(F.lit("NUM_MOTIVO_TRAT_DIF_UCI")).alias("campo_sugerido"),
        F.when(long, first_end).otherwise(F.lit(S.REASON_OVERLAP)).alias("valor_sugerido"),
        F.when(long, F.lit(shift)).otherwise(F.lit(short)).alias("sugestao"),
        F.when(long, F.col("num_intrp_primeira")).alias("NUM_INTRP_INIC_MANOBRA_UCI_sugerido"),
    ]


def _oriented(pairs: DataFrame, names: dict[str, tuple[str, str]]) -> list[Column]:
    """``{output: (side, column)}`` with side 1 the lower event number (ties: the earlier row)."""
    a_first = F.col("a__seq") <= F.col("b__seq")
    out = []
    for name, (side, column) in names.items():
        one, two = (f"a_{column}", f"b_{column}") if side == "1" else (f"b_{column}", f"a_{column}")
        out.append(F.when(a_first, F.col(one)).otherwise(F.col(two)).alias(name))
    return out


def list_feeder_device_pairs(df: DataFrame) -> DataFrame:
    """Overlapping events on the same feeder and device, with the correction of the second.

    Rows of one event with the same times are one interval here, with their number in ``linhas_primeira`` and
    ``linhas_segunda``: listing each UC of one event against each UC of the other would square the largest
    outage and say the same thing each time.
    """
    rows = df.withColumns({"inicio": _ini(df), "fim": _fim(df), "_seq": int_or("NUM_SEQ_INTRP")})
    rows = rows.where(blank_to_null("NUM_OPER_CHV_INTRP").isNotNull() & F.col("_seq").isNotNull())
    events = rows.groupBy(
        "ALIM_INTRP_PIN", "NUM_OPER_CHV_INTRP", "_seq", "NUM_SEQ_INTRP", "NUM_INTRP_UCI", "inicio", "fim",
        "DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP", "duracao_longa",
    ).agg(F.count("*").alias("linhas")).withColumn("_id", F.concat_ws("|", "NUM_SEQ_INTRP", "NUM_INTRP_UCI", iso_text("inicio"), iso_text("fim")))
    pairs = overlap_pairs(
        events, ["ALIM_INTRP_PIN", "NUM_OPER_CHV_INTRP"], "_id",
        ["_seq", "NUM_SEQ_INTRP", "NUM_INTRP_UCI", "DATA_HORA_INIC_INTRP", "DATA_HORA_FIM_INTRP", "duracao_longa", "linhas"],
    ).where(F.col("a__seq") != F.col("b__seq"))
    out = pairs.select("ALIM_INTRP_PIN", "NUM_OPER_CHV_INTRP", *_oriented(pairs, {
        "num_seq_primeira": ("1", "NUM_SEQ_INTRP"), "num_seq_segunda": ("2", "NUM_SEQ_INTRP"),
        "num_intrp_primeira": ("1", "NUM_INTRP_UCI"), "num_intrp_segunda": ("2", "NUM_INTRP_UCI"),
        "fim_primeira": ("1", "DATA_HORA_FIM_INTRP"), "inicio_segunda_atual": ("2", "DATA_HORA_INIC_INTRP"),
        "segunda_duracao_longa": ("2", "duracao_longa"), "linhas_primeira": ("1", "linhas"), "linhas_segunda": ("2", "linhas"),
    }))
    return out.select("*", *_second_of_pair(out, F.col("fim_primeira"), S.MSG_SHIFT_EVENT, S.MSG_SHORT_EVENT, "DATA_HORA_INIC_INTRP"))


def list_uc_pairs(df: DataFrame) -> DataFrame:
    """Overlapping records of the same UC and post, with the correction of the second."""
    rows = df.withColumns({"inicio": _ini_uc(df), "fim": _fim(df), "_seq": int_or("NUM_SEQ_INTRP", MAX_SEQ)})
    pairs = overlap_pairs(
        rows, ["NUM_UC_UCI", "NUM_POSTO_UCI"], "NUM_INTRP_UCI",
        ["_seq", "NUM_SEQ_INTRP", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", "duracao_longa"],
    )
    out = pairs.select("NUM_UC_UCI", "NUM_POSTO_UCI", *_oriented(pairs, {
        "num_seq_primeira": ("1", "NUM_SEQ_INTRP"), "num_seq_segunda": ("2", "NUM_SEQ_INTRP"),
        "num_intrp_primeira": ("1", "NUM_INTRP_UCI"), "num_intrp_segunda": ("2", "NUM_INTRP_UCI"),
        "fim_primeira": ("1", "DATA_HORA_FIM_INTRP"), "inicio_segunda_atual": ("2", "DTHR_INICIO_INTRP_UC"),
        "segunda_duracao_longa": ("2", "duracao_longa"),
    }))
    return out.select("*", *_second_of_pair(out, F.col("fim_primeira"), S.MSG_SHIFT_UC, S.MSG_SHORT_UC, "DTHR_INICIO_INTRP_UC"))


def list_missing_codes(df: DataFrame) -> DataFrame:
    """Rows without cause or component, with the field to fill."""
    cause, comp = is_blank("COD_CAUSA_INTRP"), is_blank("COD_COMP_INTRP")
    return df.where(cause | comp).select(
        "ANOMES_PROCESSAMENTO", "REGIONAL_ORIGEM", *S.RECORD_KEY, "NUM_OCORRENCIA_ADMS", "DESC_INTRP", "TIPO_EQP_INTRP",
        "NUM_OPER_CHV_INTRP", "COD_CAUSA_INTRP", "COD_COMP_INTRP",
        F.when(cause & comp, F.lit("COD_CAUSA_INTRP,COD_COMP_INTRP")).when(cause, F.lit("COD_CAUSA_INTRP"))
        .otherwise(F.lit("COD_COMP_INTRP")).alias("campo_sugerido"),
        F.lit(S.MSG_REVIEW_CODES).alias("sugestao"),
    )
