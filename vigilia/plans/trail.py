"""The whole month in one application: union, assessment, queue, device analysis, treatment, indicators, pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.sinks import append_log, snapshot_once
from ..sources.versions import VersionedTable
from . import compensation as comp
from . import deploy, indicators, marts, quality

STEPS = ["uniao", "apuracao", "pendencias", "sobreposicao_interrupcao", "sobreposicao_uc", "sobreposicao_uc_fase2", "tratamento",
         "indicadores", "ressarcimento"]
# The UC overlap steps change the assessment and run only when asked for.
DEFAULT_STEPS = [s for s in STEPS if not s.startswith("sobreposicao_uc")]


class Trail:
    """Runs the steps of a month in order; every stage is a table below ``root``, published whole, that the next one reads."""

    def __init__(self, spark: SparkSession, root: str, anomes: str, run_ts: str, run_id: str = "run") -> None:
        self.spark, self.root, self.anomes, self.run_ts, self.run_id = spark, root.rstrip("/"), anomes, run_ts, run_id
        self.order = 0

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}" if stage == "uniao" else f"{self.root}/{stage}/anomes={self.anomes}"

    def table(self, stage: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path(stage))

    def read(self, stage: str) -> DataFrame:
        return self.table(stage).read()

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        return self.table(stage).publish(df)

    def release(self, stages: list[str]) -> None:
        """Deletes all but the current state of the stages; frames read from earlier ones can be read no more."""
        for stage in stages:
            self.table(stage).release()

    def log(self, step: str, status: str, message: str = "") -> None:
        self.order += 1
        row = [(self.run_id, self.anomes, self.order, step, status, message, self.run_ts)]
        append_log(self.spark.createDataFrame(row, S.STEP_LOG_SCHEMA), f"{self.root}/log_etapas")

    def run(self, months: DataFrame, targets: DataFrame, vrc: DataFrame | None = None, billed: DataFrame | None = None,
            billed_counts: DataFrame | None = None, consumer_counts: DataFrame | None = None, steps: list[str] | None = None,
            drop_cancelled: bool = True, tiebreak: list | None = None) -> dict[str, DataFrame]:
        work = {
            "uniao": lambda: self.save("uniao", marts.build_union(months, tiebreak)),
            "apuracao": lambda: self.save(
                "apuracao", marts.assess_month(self.read("uniao"), self.anomes, self.run_ts, drop_cancelled=drop_cancelled)),
            "pendencias": lambda: self.save("pendencias", quality.issue_queue(self.read("apuracao"), self.run_ts)),
            "sobreposicao_interrupcao": lambda: self.save(
                "sobreposicao_interrupcao", quality.device_containment(self.read("apuracao"), self.anomes)),
            "sobreposicao_uc": lambda: self._deploy("sobreposicao_uc", quality.uc_containment(
                self.read("apuracao"), self.anomes, self.run_ts), "91"),
            "sobreposicao_uc_fase2": lambda: self._deploy("sobreposicao_uc_fase2", quality.uc_trim(
                self.read("apuracao"), self.run_ts), "trim"),
            "tratamento": self._treat,
            "indicadores": lambda: self._indicators(billed, billed_counts, consumer_counts),
            "ressarcimento": lambda: self.save("ressarcimento", comp.compensation(
                self.read("indicadores_uc"), targets, self.anomes, self.run_ts, vrc)),
        }
        done = {}
        wanted = set(steps or DEFAULT_STEPS)
        for step in [s for s in STEPS if s in wanted]:
            self.log(step, "processando")
            try:
                done[step] = work[step]()
            except Exception as error:
                self.log(step, "erro", str(error))
                raise
            self.log(step, "sucesso")
        return done

    def _deploy(self, stage: str, analysis: DataFrame, kind: str) -> DataFrame:
        saved = self.save(stage, analysis)
        rows = self.read("apuracao")
        changed, any_change = deploy.deploy(rows, saved, kind)
        if any_change:
            snapshot_once(rows, f"{self.root}/apuracao_antes_{stage}/anomes={self.anomes}")
            self.save("apuracao", changed)
        return saved

    def _treat(self) -> DataFrame:
        flagged = quality.treatment_flags(
            self.read("apuracao"), quality.excluded_events(self.read("sobreposicao_interrupcao")))
        # The flags are a scan and a join with a short list; log and counters read a few columns of it, so flagging
        # again costs less than storing every row a second time.
        self.save("log_tratamento", quality.removal_log(flagged, self.anomes, self.run_ts))
        self.save("tratamento_contadores", quality.treatment_counters(flagged))
        return self.save("tratado", quality.treated(flagged))

    def _indicators(self, billed, billed_counts, consumer_counts) -> DataFrame:
        before, after = self.read("apuracao"), self.read("tratado")
        base = indicators.billed_filter(indicators.scenario_base(before, after, self.anomes), billed)
        official, source = indicators.choose_denominator(billed_counts, consumer_counts)
        uc = self.save("indicadores_uc", indicators.uc_indicators(base, self.run_ts, source))
        levels = self.save("indicadores_agregado", indicators.aggregate_levels(
            uc, indicators.denominators(base, official), self.run_ts))
        return self.save("indicadores_comparativo", indicators.before_after(levels, self.run_ts))


def run_trail(spark: SparkSession, months: DataFrame, root: str, anomes: str, run_ts: str, **inputs) -> dict[str, DataFrame]:
    return Trail(spark, root, anomes, run_ts, inputs.pop("run_id", "run")).run(months, **inputs)


def step_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/log_etapas").orderBy(F.col("ordem"))
