"""Pipelines on hand-made outage rows; each documented quirk has a test that names it."""

import pytest
from pyspark.sql import functions as F

from vigilia import schema as S
from vigilia.operators.relational import stack
from vigilia.plans import anomalies, compensation, deploy, indicators, ingest, marts, quality, trail
from vigilia.plans import reference as ref

RUN = "2024-03-01T00:00:00"
DEFAULT = {
    "NUM_POSTO_UCI": "P1", "TIPO_EQP_INTRP": "C", "ESTADO_INTRP": "4", "COD_CAUSA_INTRP": "1", "COD_COMP_INTRP": "2", "TIPO_PROTOC_JUSTIF_UCI": "0",
    "NUM_OPER_CHV_INTRP": "CH1", "SIGLA_REGIONAL": "P", "KVA_INTRP": "2,5", "COD_CONJTO_ELET_ANEEL_INTRP": "K1", "TIPO_CHV_INTRP": "F",
    "NUM_OCORRENCIA_ADMS": "O1", "ANOMES_PROCESSAMENTO": "202402",
}


def raw(spark, *rows):
    """Rows ``(event, uc, start, end, {column: value})``; times are ``dd HH:MM[:SS]`` of February 2024."""
    names = [*S.EXPORT_LAYOUT, "REGIONAL_ORIGEM", "ANOMES_PROCESSAMENTO"]

    def when(text):
        return text if text is None or len(text) > 11 or not text[:1].isdigit() else f"2024-02-{text}" + (":00" if text.count(":") == 1 else "")

    out = []
    for seq, uc, start, end, extra in rows:
        row = dict.fromkeys(names)
        row.update(DEFAULT, NUM_SEQ_INTRP=seq, NUM_INTRP_UCI=seq, NUM_UC_UCI=uc, DATA_HORA_INIC_INTRP=when(start), DATA_HORA_FIM_INTRP=when(end),
                   DTHR_INICIO_INTRP_UC=when(start))
        row.update(extra)
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, ", ".join(f"{n} string" for n in names))


def uni(spark, *rows):
    return marts.build_union(raw(spark, *rows))


def test_union_types_flags_and_region(spark):
    df = uni(spark, ("1", "10", "01 10:00", "01 10:02:59", {}), ("2", "10", "01 10:00", "01 09:00", {"SIGLA_REGIONAL": "", "REGIONAL_ORIGEM": "oes"}),
             ("3", "10", "invalido", "01 09:00", {"SIGLA_REGIONAL": "?"}))
    got = {r.NUM_SEQ_INTRP: (r.duracao, r.erro_duracao, r.duracao_longa, r.REGIONAL_ORIGEM) for r in df.collect()}
    assert got["1"][1:] == (False, False, "CSL") and got["1"][0] == pytest.approx(2 + 59 / 60)
    assert got["2"] == (-60.0, True, False, "OES")
    # Q11: an unknown region is the company in the union.
    assert got["3"] == (None, False, False, S.COMPANY)


def test_month_window_needs_both_times(spark):
    df = uni(spark, ("1", "1", "01 00:00", "05 00:00", {}), ("2", "1", "2024-01-31 23:00:00", "02 00:00", {}),
             ("3", "1", "28 00:00", "2024-03-01 00:00:00", {}), ("4", "1", "03 00:00", "04 00:00", {"ESTADO_INTRP": "7"}), ("5", "1", "03 00:00", "04 00:00", {"ESTADO_INTRP": None}))
    month = lambda **k: sorted(r.NUM_SEQ_INTRP for r in marts.assess_month(df, "202402", RUN, **k).collect())
    assert month() == ["1", "4", "5"] and month(drop_cancelled=True) == ["1", "5"]
    # Q16: without a validation status the rejection filter has nothing to read.
    assert month(drop_rejected=True) == ["1", "4", "5"]


def test_month_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "u")
    uni(spark, ("1", "1", "01 00:00", "05 00:00", {})).write.parquet(path)
    plan = marts.assess_month(spark.read.parquet(path), "202402", RUN).select("NUM_UC_UCI")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(DATA_HORA_INIC_INTRP_TS), IsNotNull(DATA_HORA_FIM_INTRP_TS), GreaterThanOrEqual(" in plan
    assert "ReadSchema: struct<NUM_UC_UCI:string,DATA_HORA_INIC_INTRP_TS:timestamp_ntz,DATA_HORA_FIM_INTRP_TS:timestamp_ntz>" in plan


def test_governance_latest_decision(spark):
    """Q15: decisions join on the three columns; a key with a missing part stays pending."""
    df = uni(spark, ("1", "1", "01 00:00", "01 01:00", {}), ("2", "1", "01 00:00", "01 01:00", {"NUM_POSTO_UCI": None}))
    log = spark.createDataFrame([("1|P1|1", "rejeitado", "2024-02-02 00:00:00"), ("1|P1|1", "validado", "2024-02-01 00:00:00"), ("2||1", "validado", "2024-02-02 00:00:00")],
                                "chave_registro string, status string, criado_em string")
    got = {r.NUM_SEQ_INTRP: (r.status_validacao, r.validado) for r in marts.apply_governance(df, log).collect()}
    assert got == {"1": ("rejeitado", False), "2": ("pendente", False)}
    assert marts.apply_governance(df).select("status_validacao").distinct().collect()[0][0] == "pendente"


def test_issue_queue(spark):
    df = uni(spark, ("1", "10", "01 10:00", "01 08:00", {}), ("2", "11", "02 10:00", "02 05:00", {}),
             ("3", "12", "03 10:00", "03 12:00", {}), ("4", "13", "03 11:00", "03 13:00", {}), ("5", "14", "03 11:30", "03 12:30", {"COD_CAUSA_INTRP": " "}),
             ("6", "20", "05 10:00", "05 15:00", {"NUM_OPER_CHV_INTRP": None}), ("7", "20", "05 11:00", "05 12:00", {"NUM_OPER_CHV_INTRP": " "}),
             ("8", "20", "05 11:00", "05 12:00", {"NUM_OPER_CHV_INTRP": None, "TIPO_PROTOC_JUSTIF_UCI": "1"}))
    q = quality.issue_queue(df, RUN)
    assert q.columns == S.ISSUE_COLUMNS
    rows = q.collect()
    by = lambda rule: [r for r in rows if r.regra == rule]
    neg = {r.num_seq_intrp: (r.valor_sugerido, r.acao_sugerida) for r in by("horario_negativo")}
    # Q10: the queue suggests start plus three hours, and nothing beyond three hours of gap.
    assert neg == {"1": ("01/02/2024 13:00:00", "corrigir_fuso"), "2": (None, "revisao_manual")}
    end = {r.num_seq_intrp: r.valor_sugerido for r in quality.issue_queue(df, RUN, "fim").where("regra = 'horario_negativo'").collect()}
    assert end["1"] == "01/02/2024 11:00:00"
    # One row per event overlapped; of a pair the higher number goes.
    assert sorted(r.num_seq_intrp for r in by("sobreposicao_interrupcao")) == ["4", "5", "5"]
    assert [(r.num_seq_intrp, r.justificativa_sistema[-1]) for r in by("sobreposicao_uc")] == [("7", "6")]
    assert [(r.num_seq_intrp, r.campo_sugerido, r.gravidade) for r in by("sem_causa_componente")] == [("5", "COD_CAUSA_INTRP", "media")]
    # Q18: severity sorts as text, so "media" precedes "alta" in descending order.
    assert q.orderBy(*quality.queue_order(q)).first().gravidade == "media"


def test_treatment_keeps_three_valued_logic(spark):
    """Q1: a row with an unreadable time leaves without a log entry; the closing track keeps it."""
    df = uni(spark, ("1", "1", "01 10:00", "01 11:00", {}), ("2", "1", "02 10:00", None, {}), ("3", "1", "03 10:00", "03 09:00", {"COD_COMP_INTRP": ""}),
             ("4", "1", "04 10:00", "04 12:00", {}), ("5", "2", "04 10:30", "04 11:00", {}), ("6", "1", "05 10:00", None, {"COD_CAUSA_INTRP": None}))
    analysis = quality.device_containment(df, "202402")
    flags = quality.treatment_flags(df, quality.excluded_events(analysis))
    assert sorted(r.NUM_SEQ_INTRP for r in quality.treated(flags).collect()) == ["1", "4"]
    log = sorted((r.NUM_SEQ_INTRP, r.regra) for r in quality.removal_log(flags, "202402", RUN).collect())
    assert log == [("3", "horario_negativo"), ("3", "sem_causa_componente"), ("5", "sobreposicao_interrupcao"), ("6", "sem_causa_componente")]
    c = quality.treatment_counters(flags).first()
    assert (c.total_original, c.removido_tempo_nulo, c.total_final) == (6, 1, 2)
    kept = marts.close_month_treat(df)
    assert sorted(r.NUM_SEQ_INTRP for r in kept.collect()) == ["1", "2", "4", "5"]
    assert marts.closing_counters(df).first().total_final == 4


def test_device_containment_tie_goes_to_the_lower_number(spark):
    """Q13: in device analysis a number that is no number counts as 0."""
    df = uni(spark, ("7", "1", "01 10:00", "01 12:00", {}), ("5", "2", "01 10:00", "01 12:00", {}), ("x", "3", "02 10:00", "02 12:00", {}), ("9", "4", "02 10:00", "02 12:00", {}))
    got = {r.interrupcao: r.acao_sugerida for r in quality.device_containment(df, "202402").collect()}
    assert got == {"5": "MANTER", "7": "EXCLUIR", "x": "MANTER", "9": "EXCLUIR"}
    s = quality.containment_summary(quality.device_containment(df, "202402")).first()
    assert (s.total_interrupcoes, s.manter, s.excluir) == (4, 2, 2)


def test_uc_containment_tie_goes_against_the_missing_number(spark):
    df = uni(spark, ("x", "1", "02 10:00", "02 12:00", {}), ("9", "1", "02 10:00", "02 12:00", {}), ("3", "1", "02 10:30", "02 11:30", {"TIPO_PROTOC_JUSTIF_UCI": "1"}))
    got = [(r.num_seq_intrp, r.num_seq_contem, r.horas_uc_reduzidas, r.chi_reduzido_estimado) for r in quality.uc_containment(df, "202402", RUN).collect()]
    assert got == [("x", "9", 2.0, 5.0)]


def test_deployments(spark):
    df = uni(spark, ("1", "1", "01 10:00", "01 14:00", {}), ("2", "1", "01 11:00", "01 12:00", {}), ("3", "1", "01 13:00", "01 16:00", {}))
    marked, changed = deploy.deploy(df, quality.uc_containment(df, "202402", RUN), "91")
    assert changed and {r.NUM_SEQ_INTRP: r.NUM_MOTIVO_TRAT_DIF_UCI for r in marked.collect()} == {"1": None, "2": "91", "3": None}
    plan = quality.uc_trim(df, RUN)
    assert [(r.num_seq_intrp_alvo, r.num_seq_intrp_origem, r.minutos_interseccao) for r in plan.collect()] == [("3", "1", 60)]
    moved, _ = deploy.deploy(df, plan, "trim")
    row = moved.where("NUM_SEQ_INTRP = '3'").first()
    # Q25: text and typed start move together.
    assert row.DTHR_INICIO_INTRP_UC == "2024-02-01 14:00:00" and row.DTHR_INICIO_INTRP_UC_TS.hour == 14 and row.NUM_INTRP_INIC_MANOBRA_UCI == "1"
    same, changed = deploy.deploy(df, plan.limit(0), "trim")
    assert not changed and same is df
    # Q28: both logs are appended to, so both have the same way of naming who did it.
    one = deploy.containment_log(quality.uc_containment(df, "202402", RUN), "202402", RUN, "ana", "gestor", "ok")
    two = deploy.trim_log(plan, "202402", RUN, "ana", "gestor", "ok")
    assert one.columns[:7] == two.columns[:7] and one.count() == two.count() == 1


def test_decisions(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",)], "chave_registro string")
    rows = deploy.register_decisions(keys, "202402", "r", "validar", " ok ", "ana", "gestor", RUN)
    again = deploy.register_decisions(keys, "202402", "r", "validar", " ok ", "ana", "gestor", RUN)
    assert rows.count() == 2 and rows.exceptAll(again).count() == 0
    assert rows.first().justificativa == "ok"
    for bad in ({"acao": "apagar"}, {"justificativa": "  "}):
        args = {"acao": "validar", "justificativa": "ok", **bad}
        with pytest.raises(ValueError):
            deploy.register_decisions(keys, "202402", "r", args["acao"], args["justificativa"], "ana", "gestor", RUN)
    assert {r.status_validacao for r in deploy.governance_entries(rows).collect()} == {"validado"}


def indicator_tables(spark, before, after=None, **kw):
    return indicators.continuity_indicators(before, after if after is not None else before, "202402", RUN, **kw)


def test_indicators(spark):
    df = uni(spark, ("1", "10", "01 10:00:59", "01 10:03:00", {}), ("2", "10", "02 10:00", "02 10:02:59", {}), ("3", "10", "03 10:00", "03 12:00", {"NUM_INTRP_INIC_MANOBRA_UCI": "1"}),
             ("4", "10", "04 10:00", "04 11:00", {"NUM_MOTIVO_TRAT_DIF_UCI": "12"}), ("5", "10", "05 10:00", "05 11:00", {"TIPO_PROTOC_JUSTIF_UCI": " "}),
             ("6", "11", "05 10:00", "05 11:00", {"INDIC_SIT_PROCES_INDIC_UCI": "X"}), ("7", "11", "06 10:00", "06 11:00", {"SIGLA_REGIONAL": "L"}))
    out = indicator_tables(spark, df, df.where("NUM_SEQ_INTRP <> '3'"))
    uc = {(r.cenario, r.num_uc_uci): (round(r.dic_horas, 6), r.fic, r.dmic_horas, r.interrupcoes_distintas) for r in out["indicadores_uc"].collect()}
    # Q2, Q22: three minute marks count although 2 min 1 s elapsed; a manoeuvre row counts in hours, not in events.
    assert uc[("antes", "10")] == (2.05, 1, 2.0, 2) and uc[("depois", "10")] == (0.05, 1, 0.05, 1)
    assert uc[("antes", "11")] == (1.0, 1, 1.0, 1)
    levels = {(r.cenario, r.nivel, r.regional_origem): (r.quantidade_ucs, r.dec_horas) for r in out["indicadores_agregado"].where("nivel <> 'CONJUNTO'").collect()}
    # Region denominators count every UC of the base, net or not.
    assert levels[("antes", "REGIONAL", "CSL")] == (2.0, pytest.approx(1.025)) and levels[("antes", S.COMPANY, S.COMPANY)] == (3.0, pytest.approx(3.05 / 3))
    comp = {r.nivel: r for r in out["indicadores_comparativo"].where("regional_origem = 'CSL'").collect()}
    assert comp["REGIONAL"].dec_delta == pytest.approx(-1.0) and comp["REGIONAL"].fec_delta == 0.0


def test_scenarios_stack_by_name(spark):
    """Q7: a different column order between the two tables changes nothing."""
    df = uni(spark, ("1", "10", "01 10:00", "01 12:00", {}))
    shuffled = df.select(*sorted(df.columns, reverse=True))
    out = indicator_tables(spark, df, shuffled)["indicadores_uc"].collect()
    assert {(r.cenario, r.dic_horas) for r in out} == {("antes", 2.0), ("depois", 2.0)}


def test_billed_twice_counts_once(spark):
    """Q5: a UC billed in two regions does not double its hours."""
    df = uni(spark, ("1", "10", "01 10:00", "01 12:00", {}), ("2", "11", "01 10:00", "01 12:00", {}))
    billed = spark.createDataFrame([("10", "S", "CSL"), ("10", "s ", "NRT"), ("11", "N", "CSL")], "uc string, faturado string, regional string")
    out = indicator_tables(spark, df, billed=billed)["indicadores_uc"].where("cenario = 'antes'").collect()
    assert [(r.num_uc_uci, r.dic_horas, r.filtro_faturamento) for r in out] == [("10", 2.0, S.BILLED_APPLIED)]
    bad = indicator_tables(spark, df, billed=billed.drop("faturado"))["indicadores_uc"].first()
    assert bad.filtro_faturamento == S.BILLED_BAD_COLUMNS


def test_official_denominators(spark):
    """Q23, Q26, Q27: the source's own total is left out, the company sums regions seen, ``UC`` is a count column."""
    df = uni(spark, ("1", "10", "01 10:00", "01 12:00", {}), ("2", "11", "01 10:00", "01 12:00", {"SIGLA_REGIONAL": "?"}))
    counts = spark.createDataFrame([("CSL", "4"), ("NRT", "100"), (S.COMPANY, "104")], "REGIONAL_TOTAL string, UC string")
    out = indicator_tables(spark, df, consumer_counts=counts)
    rows = {(r.nivel, r.regional_origem): r.quantidade_ucs for r in out["indicadores_agregado"].where("cenario = 'antes' AND nivel <> 'CONJUNTO'").collect()}
    assert rows == {("REGIONAL", "CSL"): 4.0, ("REGIONAL", S.COMPANY): 1.0, (S.COMPANY, S.COMPANY): 5.0}
    assert out["indicadores_uc"].first().fonte_denominador == S.DENOMINATOR_CONSUMERS


IND = [("antes", "1", "CSL", 10.0, 3.0, 4.0), ("antes", "2", "CSL", 10.0, 3.0, 4.0), ("antes", "3", "CSL", 10.0, 3.0, 4.0)]


def test_compensation_forms(spark):
    """Q6, Q8, Q9: repeated targets, zero targets, missing reference values, and no reference table at all."""
    ind = spark.createDataFrame(IND, "cenario string, num_uc_uci string, regional_origem string, dic_horas double, fic double, dmic_horas double")
    targets = spark.createDataFrame([("1", "5,5", "9", "9"), ("1", "6", "1", "9"), ("2", "0", None, None)], "ISN_UC string, META_DIC string, META_FIC string, META_DMIC string")
    vrc = spark.createDataFrame([("1", "B", "1", 73.0), ("1", "B", "1", 7.0), ("2", "A", "3a", 73.0)], "ISN_UC string, COD_GRUPO_NIVEL_TENSAO_UC string, COD_NIVEL_TENSAO_UC string, VRC double")
    got = {r.uc: r for r in compensation.compensation(ind, targets, "202402", RUN, vrc).collect()}
    assert len(got) == 3
    assert (got["1"].limite_dic_horas, got["1"].limite_fic, got["1"].viola_dic, got["1"].viola_fic) == (6.0, 9.0, True, False)
    assert got["1"].valor_ressarcimento_estimado == pytest.approx(34.0)
    assert got["2"].viola_dic and got["2"].valor_ressarcimento_estimado == pytest.approx(40.0)
    assert not got["3"].possui_violacao and got["3"].vrc == 0.0
    old = {r.num_uc_uci: r for r in compensation.compensation_excess(ind, targets, RUN, vrc).collect()}
    assert old["1"].excedente_dic_horas == 4.0 and old["2"].compensacao_dic == 0.0 and old["2"].possui_violacao
    none = {r.num_uc_uci: r for r in compensation.compensation_excess(ind, targets, RUN).collect()}
    assert none["1"].compensacao_dic is None and none["1"].valor_ressarcimento_estimado == 0.0
    assert none["1"].status_formula_ressarcimento == S.FORMULA_V1_NONE


def test_stage_summary_counts(spark):
    """Q17: missing codes count rows, negative times count events, UC overlap is computed."""
    df = uni(spark, ("1", "1", "01 10:00", "01 09:00", {"COD_CAUSA_INTRP": None}), ("1", "2", "01 10:00", "01 09:00", {"COD_CAUSA_INTRP": None}),
             ("2", "3", "03 10:00", "03 15:00", {}), ("3", "3", "03 11:00", "03 12:00", {}))
    r = quality.stage_summary(df, "202402", RUN, "x").first()
    assert (r.total_registros, r.horario_negativo, r.sem_causa_componente, r.sobreposicao_interrupcao, r.sobreposicao_uc) == (4, 1, 2, 2, 1)
    assert r.pendencias_totais == 4 and r.rejeitados_por_atividade_json == "{}"


def test_closing_load(spark):
    """Q19: without any key column all rows stay; with one, the first file wins and a missing part is a value."""
    df = raw(spark, ("1", "1", "01/02/2024 10:00", "01/02/2024 10:03", {}), ("1", "1", "01 10:00", "01 12:00", {}), ("2", None, "x", "01 12:00", {}))
    tagged = df.withColumn("arquivo_origem", F.concat(F.lit("f"), F.monotonically_increasing_id().cast("string"), F.lit("_CSL.CSV")))
    out = {r.NUM_SEQ_INTRP: r for r in marts.close_month_load(tagged, "202402").collect()}
    assert out["1"].duracao_minutos == 3 and out["1"].duracao_longa and out["1"].REGIONAL_ORIGEM == "CSL" and out["2"].erro_duracao is None
    assert marts.close_month_load(tagged.drop(*S.RECORD_KEY), "202402").count() == 3


def test_merge_periods_any_row_excludes(spark):
    """Q12: in the assessor one excluded row makes the whole period excluded; a null event counts as one value."""
    rows = raw(spark, ("1", "9", "01 10:00", "01 11:00", {}), ("2", "9", "01 11:00", "01 12:00", {"TIPO_PROTOC_JUSTIF_UCI": "1"}), ("3", "9", "02 10:00", "02 10:01", {}))
    cons = spark.createDataFrame([("P", 10.0, 2)], "regional string, consumidores double, mes int")
    billed = spark.createDataFrame([(" 9 ",), ("",)], "UC_FATURADAS string")
    out = indicators.assess_ci_chi(rows, rows, billed, cons)["resumo"].orderBy(indicators.area_rank(), indicators.class_rank()).collect()
    got = [(r.arquivo_origem, r.classificacao, r.CI, round(r.CHI, 4), r.qtd_intrp_longas, r.qtd_interrupcoes_distintas) for r in out]
    assert got == [("P", "Expurgo", 1, 2.0, 1, 0), ("P", "Liquido", 1, 0.0167, 0, 1), (S.COMPANY_TITLE, "Expurgo", 1, 2.0, 1, 0), (S.COMPANY_TITLE, "Liquido", 1, 0.0167, 0, 1)]


def test_outliers(spark):
    df = uni(spark, ("1", "1", "01 00:00", "03 00:00", {}), ("1", "2", "01 00:00", "03 00:00", {}), ("2", "1", "01 00:00", "02 23:59", {}))
    out = quality.duration_outliers(df, RUN)
    assert [(r.NUM_SEQ_INTRP, r.duracao_horas, r.chi_estimado_horas_uc) for r in out.collect()] == [("1", 48.0, 96.0)]
    assert set(S.EVENT_COLUMNS) <= set(out.columns)


def test_reference_marts(spark):
    """Q20: on-demand marts are the same operator with another source list."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "n int, v string")
    got = {r.fonte: (r.linhas_raw, r.linhas_mart, r.status) for r in ref.marts_summary(spark, {"metas_uc": df, "falta": None}).collect()}
    assert got == {"metas_uc": (3, 2, "processado"), "falta": (0, 0, "pendente_raw")}
    assert ref.as_text(df).dtypes == [("N", "string"), ("V", "string")]


def test_consolidate(spark):
    rows = raw(spark, ("1", "1", "01/02/2024 10:00:00", "01/02/2024 12:00:00", {"PID": "E1", "CONS_INTRP": "1.000,0"}), ("1", "1", "01/02/2024 10:00:00", "01/02/2024 11:00:00", {"PID": "E1", "CONS_INTRP": "10"}),
               ("2", "1", "01/03/2024 10:00:00", "01/03/2024 11:00:00", {"PID": "E2", "CONS_INTRP": "1"}), ("3", "1", "02/02/2024 10:00:00", "02/02/2024 11:00:00", {"PID": " ", "CONS_INTRP": "-1"}))
    rows = rows.withColumns({"arquivo_origem": F.lit("CSL"), "arquivo_csv": F.lit("a"), "snapshot_ts": F.when(F.col("CONS_INTRP") == "10", F.lit("2")).otherwise(F.lit("1"))})
    out = ingest.consolidate(rows, 2024, 2)
    assert [(r.PID, r.CHI) for r in out["eventos"].collect()] == [("E1", 10.0)]
    assert sorted(r.NUM_INTRP_UCI for r in out["ucs"].collect()) == ["1", "3"]


def test_trail(spark, tmp_path):
    """Q24: the UC overlap steps run only on request; Q21: listings can keep violations only."""
    rows = raw(spark, ("1", "1", "01 10:00", "01 14:00", {}), ("2", "1", "01 11:00", "01 12:00", {"NUM_OPER_CHV_INTRP": "CH2"}), ("3", "1", "01 13:00", "01 16:00", {"NUM_OPER_CHV_INTRP": "CH3"}),
               ("4", "2", "02 10:00", "02 11:00", {"ESTADO_INTRP": "7"}), ("5", "2", "02 10:00", "02 09:00", {}))
    targets = spark.createDataFrame([("1", "1")], "ISN_UC string, META_DIC string")
    done = trail.run_trail(spark, rows, str(tmp_path / "a"), "202402", RUN, targets=targets)
    assert {k: v.count() for k, v in done.items()} == {"uniao": 5, "apuracao": 4, "pendencias": 2, "sobreposicao_interrupcao": 4, "tratamento": 3, "indicadores": 3, "ressarcimento": 2}
    assert [r.etapa for r in trail.step_log(spark, str(tmp_path / "a")).where("status = 'sucesso'").collect()] == trail.DEFAULT_STEPS
    assert {r.cenario: r.dic_horas for r in done["ressarcimento"].where("possui_violacao").collect()} == {"antes": 8.0, "depois": 8.0}
    full = trail.run_trail(spark, rows, str(tmp_path / "b"), "202402", RUN, targets=targets, steps=trail.STEPS)
    # Event 2 is contained in 1 (reason 91), event 3 starts when 1 ends.
    assert {r.cenario: r.dic_horas for r in full["ressarcimento"].collect()} == {"antes": 6.0, "depois": 6.0}
    with pytest.raises(Exception):
        trail.run_trail(spark, rows.drop("NUM_UC_UCI"), str(tmp_path / "c"), "202402", RUN, targets=targets)
    assert trail.step_log(spark, str(tmp_path / "c")).where("status = 'erro'").count() == 1


def test_anomaly_details(spark):
    df = spark.createDataFrame([("g", "2024-02-01", 1.0, 1.0), ("g", "2024-02-02", 5.0, 1.5)], "conjunto string, d string, dec_acum_mensal double, fec_acum_mensal double")
    daily = df.select("conjunto", F.col("d").cast("date").alias("dia"), "dec_acum_mensal", "fec_acum_mensal", F.lit(1.0).alias("dec_acum_anual"), F.lit(1.0).alias("fec_acum_anual"))
    targets = spark.createDataFrame([("g", 366.0, 366.0), ("g", 1.0, 1.0)], "conjunto string, meta_dec double, meta_fec double")
    got = [(r.degrau_dia_dec, r.razao_dia_meta_dec, r.prioridade) for r in anomalies.daily_steps(daily, targets).orderBy("dia").collect()]
    assert got == [(1.0, 1.0, "SEM_PRIORIDADE"), (4.0, 4.0, "ALTA")]
    topo = anomalies.latest_topology(spark.createDataFrame([("u", 1, "a"), ("u", 2, "b")], "uc string, t int, v string"), "uc", ["t"], ["v"])
    assert topo.collect()[0].v == "b"


def test_queue_listing_is_complete(spark):
    df = uni(spark, ("1", "1", "01 10:00", "01 12:00", {"ALIM_INTRP_PIN": "A"}), ("2", "1", "01 11:00", "01 11:02", {"ALIM_INTRP_PIN": "A"}))
    dev = quality.list_feeder_device_pairs(df).first()
    assert (dev.num_seq_primeira, dev.num_seq_segunda, dev.campo_sugerido, dev.valor_sugerido) == ("1", "2", "NUM_MOTIVO_TRAT_DIF_UCI", "91")
    uc = quality.list_uc_pairs(df).first()
    assert (uc.num_seq_primeira, uc.num_seq_segunda, uc.sugestao) == ("1", "2", S.MSG_SHORT_UC)
    assert stack(df, df).count() == 4
