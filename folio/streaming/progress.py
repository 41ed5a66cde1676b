"""Progress of running plans as event rows: what passes through each stage is observed where it passes, without another job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, pos long, stage string, rows long, detail string"


class Stages:
    """Stages of a batch run: `through` marks one, `events` gives a row for each once an action has run them."""

    def __init__(self, run: str):
        self.run = run
        self.observed: list[tuple[str, Observation]] = []

    def through(self, stage: str, df: DataFrame, **more) -> DataFrame:
        """df, whose rows are counted as the stage's; more: aggregates by name, told as detail."""
        observation = Observation(f"{self.run}-{len(self.observed)}-{stage}")
        self.observed.append((stage, observation))
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), *[column.alias(name) for name, column in more.items()])

    def events(self, spark: SparkSession) -> DataFrame:
        rows = []
        for pos, (stage, observation) in enumerate(self.observed):
            told = dict(observation.get)
            rows.append((self.run, pos, stage, told.pop("rows"), json.dumps(told, default=str, sort_keys=True)))
        return spark.createDataFrame(rows, SCHEMA)


class BatchProgress(StreamingQueryListener):
    """A listener that turns the observed metrics of a stream's batches into event rows, a batch once."""

    def __init__(self, query_name: str):
        self.query_name = query_name
        self.seen: dict[tuple[int, str], tuple] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.query_name:
            for stage, row in progress.observedMetrics.items():
                told = row.asDict()
                self.seen[progress.batchId, stage] = (self.query_name, progress.batchId, stage, told.pop("rows", None), json.dumps(told, default=str, sort_keys=True))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.seen[k] for k in sorted(self.seen)], SCHEMA)
