"""Governed changes: deploying overlap analyses, decisions and change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import record_key, text
from ..functions.time import parse_ts
from ..operators.relational import first_per_key


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_chave", record_key())


def deploy_uc_containment(rows: DataFrame, analysis: DataFrame) -> DataFrame:
    """Set the treatment reason 91 on every record the analysis marks; all other rows stay as they are."""
    marked = analysis.where(F.col("acao_sugerida") == "CLASSIFICAR_91").select(
        F.col("chave_registro").alias("_chave")
    ).distinct().withColumn("_hit", F.lit(True))
    reason = F.when(F.col("_hit"), F.lit(S.REASON_OVERLAP)).otherwise(text("NUM_MOTIVO_TRAT_DIF_UCI"))
    return _with_key(rows).join(marked, "_chave", "left").withColumn("NUM_MOTIVO_TRAT_DIF_UCI", reason).select(*rows.columns)


def deploy_uc_trim(rows: DataFrame, analysis: DataFrame) -> DataFrame:
    """Move the start of adjusted records and note the event that caused it.

    Text and typed start move together, so later stages see the same start whichever they read.
    """
    pending = analysis.where(F.col("status_pendencia") == "pendente").select(
        F.col("chave_registro").alias("_chave"), F.col("inicio_sugerido").alias("_ini"), F.col("num_seq_intrp_origem").alias("_origem")
    )
    one = first_per_key(pending, ["_chave"], ["_ini", "_origem"])
    changes = {
        "DTHR_INICIO_INTRP_UC": F.coalesce("_ini", text("DTHR_INICIO_INTRP_UC")),
        "NUM_INTRP_INIC_MANOBRA_UCI": F.coalesce("_origem", text("NUM_INTRP_INIC_MANOBRA_UCI")),
    }
    if "DTHR_INICIO_INTRP_UC_TS" in rows.columns:
        changes["DTHR_INICIO_INTRP_UC_TS"] = F.coalesce(parse_ts("_ini"), F.col("DTHR_INICIO_INTRP_UC_TS"))
    return _with_key(rows).join(one, "_chave", "left").withColumns(changes).select(*rows.columns)


def _who(anomes, usuario, perfil, ip, pc, justificativa, run_ts) -> list[Column]:
    values = {"anomes": anomes, "implantado_em": run_ts, "usuario": usuario, "perfil": perfil, "ip": ip, "pc": pc,
              "justificativa": justificativa}
    return [F.lit(v).alias(n) for n, v in values.items()]


def containment_log(analysis: DataFrame, anomes: str, run_ts: str, usuario: str, perfil: str, justificativa: str,
                    ip: str = "", pc: str = "") -> DataFrame:
    return analysis.where(F.col("acao_sugerida") == "CLASSIFICAR_91").select(
        *_who(anomes, usuario, perfil, ip, pc, justificativa, run_ts), F.lit("sobreposicao_uc").alias("regra"),
        F.lit("popular_motivo_91").alias("acao"), "chave_registro", "num_seq_intrp", "num_seq_contem", "num_uc_uci",
        "num_posto_uci", "num_intrp_uci", "protocolo", "horas_uc_reduzidas", "chi_reduzido_estimado",
    )


def trim_log(analysis: DataFrame, anomes: str, run_ts: str, usuario: str, perfil: str, justificativa: str,
             ip: str = "", pc: str = "") -> DataFrame:
    return analysis.where(F.col("status_pendencia") == "pendente").select(
        *_who(anomes, usuario, perfil, ip, pc, justificativa, run_ts), "regra", "chave_registro", "num_intrp_uci_alvo",
        "num_seq_intrp_alvo", "num_uc_uci", "protocolo_uc", "inicio_original", "inicio_sugerido", "fim_alvo",
        "num_intrp_uci_origem", "num_seq_intrp_origem", "minutos_interseccao",
        F.lit("DTHR_INICIO_INTRP_UC").alias("campo_alterado"), F.col("inicio_original").alias("valor_original"),
        F.col("inicio_sugerido").alias("valor_novo"), F.lit("NUM_INTRP_INIC_MANOBRA_UCI").alias("campo_alterado_2"),
        F.lit(None).cast("string").alias("valor_original_2"), F.col("num_seq_intrp_origem").alias("valor_novo_2"),
    )


def deploy(rows: DataFrame, analysis: DataFrame, kind: str) -> tuple[DataFrame, bool]:
    """Deploy an analysis; with nothing to deploy the rows come back untouched (second value false)."""
    if analysis.isEmpty():
        return rows, False
    return {"91": deploy_uc_containment, "trim": deploy_uc_trim}[kind](rows, analysis), True


def register_decisions(keys: DataFrame, anomes: str, regra: str, acao: str, justificativa: str, usuario: str, perfil: str,
                       run_ts: str, ip: str = "", pc: str = "", origem: str = "portal_gestor") -> DataFrame:
    """Log rows of one batch of decisions over ``keys.chave_registro``.

    Ids derive from the content, so writing a batch twice yields the same rows.
    """
    if acao not in S.BATCH_DECISIONS:
        raise ValueError(f"acao must be one of {', '.join(S.BATCH_DECISIONS)}")
    if not justificativa or not justificativa.strip():
        raise ValueError("justificativa is required")
    batch = F.sha2(F.concat_ws("|", *[F.lit(v) for v in (anomes, regra, acao, usuario, run_ts)]), 256)
    return keys.select("chave_registro").distinct().select(
        F.sha2(F.concat_ws("|", batch, F.col("chave_registro")), 256).alias("id_decisao"), batch.alias("id_lote"),
        F.lit(anomes).alias("anomes"), F.lit(regra).alias("regra"), F.lit(acao).alias("acao"), "chave_registro",
        F.lit(justificativa.strip()).alias("justificativa"), F.lit(usuario).alias("usuario"), F.lit(perfil).alias("perfil"),
        F.lit(pc).alias("pc"), F.lit(ip).alias("ip"), F.lit(origem).alias("origem"),
        F.lit("registrada").alias("status_decisao"), F.lit(run_ts).alias("criado_em"),
    )


def governance_entries(decisions: DataFrame) -> DataFrame:
    """Decisions as change-log rows: the status each one sets on its record."""
    def pick(i):
        out = F.lit(None)
        for acao, values in S.DECISIONS.items():
            out = F.when(F.col("acao") == acao, F.lit(values[i])).otherwise(out)
        return out

    return decisions.select(
        F.col("id_decisao").alias("id_alteracao"), F.col("criado_em").alias("data_hora"), "usuario", "perfil", "ip", "pc",
        "chave_registro", "acao", F.lit("status_validacao").alias("campo_alterado"), F.lit("").alias("valor_original"),
        pick(2).alias("valor_novo"), "justificativa", pick(0).alias("status"), pick(1).alias("validado"),
        pick(2).alias("status_validacao"), F.col("justificativa").alias("motivo_status"),
    )


def change_requests(requests: DataFrame) -> DataFrame:
    """Change requests with the status the role gives them: applied at once, or requested."""
    return requests.withColumns({
        "acao": F.lit("solicitar_alteracao"),
        "status": F.when(F.col("perfil").isin(S.APPLYING_ROLES), F.lit("aplicado")).otherwise(F.lit("solicitado")),
        "id_alteracao": F.sha2(F.concat_ws("|", "usuario", "chave_registro", "campo", F.coalesce("valor_novo", F.lit("")), "criado_em"), 256),
    })


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Decisions by rule and action, with a total per action."""
    per_rule = decisions.groupBy("acao", "regra").agg(F.count("*").alias("total"))
    per_action = per_rule.groupBy("acao").agg(F.sum("total").alias("total")).withColumn("regra", F.lit("TODAS"))
    return per_rule.unionByName(per_action)
