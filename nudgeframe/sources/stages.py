"""A write-once record of the stages of a study."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

RECORD_SCHEMA = "stage string, settings string, n_rows long"


class StageRecord:
    """Stages of a study in their order, each a table written once.

    A stage is recorded after its table is complete. A rerun with the same settings reads
    recorded stages and goes on with the first one missing; other settings are refused. A
    stage is not built before its predecessors, nor once a later one is recorded, so what
    the last stage looks at cannot steer an earlier choice.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: str, stages: tuple[str, ...]):
        self.spark, self.folder, self.settings, self.stages = spark, folder, settings, stages

    def finished(self) -> dict[str, int]:
        """{recorded stage: rows of its table}."""
        found = {}
        for stage in self.stages:
            try:
                row = self.spark.read.schema(RECORD_SCHEMA).json(f"{self.folder}/record/{stage}").first()
            except AnalysisException as error:
                if "PATH_NOT_FOUND" in str(error):
                    continue
                raise
            if row is None:  # stopped before its line was written
                continue
            if row["settings"] != self.settings:
                raise ValueError(f"{self.folder} holds a study with other settings")
            found[stage] = row["n_rows"]
        return found

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{stage}")

    def run(self, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: as recorded, else built, written and recorded."""
        done, place = self.finished(), self.stages.index(stage)
        if stage in done:
            return self.table(stage)
        missing = [s for s in self.stages[:place] if s not in done]
        later = [s for s in self.stages[place + 1 :] if s in done]
        if missing or later:
            raise ValueError(f"{stage} comes after {missing}" if missing else f"{stage} is sealed since {later} is recorded")
        build().write.mode("overwrite").parquet(f"{self.folder}/tables/{stage}")
        line = self.spark.createDataFrame([(stage, self.settings, self.table(stage).count())], RECORD_SCHEMA)
        line.coalesce(1).write.mode("overwrite").json(f"{self.folder}/record/{stage}")
        return self.table(stage)
