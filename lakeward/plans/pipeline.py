"""The batch pipeline as composed lazy DataFrames over the driver tables.

raw -> stg -> classification -> {accepted, rejected} -> {dim_users, fact} -> mart.
Nothing here executes; callers materialise what they need. The classification
has several readers, so long-running callers ``persist()`` or write it once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakeward.operators import classify, publish, staging
from lakeward.session import ensure_checkpoint_dir
from lakeward.sources.adapters import raw_events_from_driver
from lakeward.sources.tables import read_table


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events_from_driver(read_table(spark, sf_dir, "events"))


@dataclass
class Pipeline:
    spark: SparkSession
    sf_dir: str
    hot_event_ids: object = "auto"
    now: object = None
    # Write the classification once (reliable checkpoint in the shared
    # checkpoint dir) when several outputs read it.
    materialize: bool = False
    _cache: dict = field(default_factory=dict)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def raw(self) -> DataFrame:
        return self._get("raw", lambda: raw_events(self.spark, self.sf_dir))

    @property
    def stg(self) -> DataFrame:
        return self._get("stg", lambda: staging.stage_events(self.raw))

    @property
    def classified(self) -> DataFrame:
        def build():
            df = classify.classify_events(self.stg, now=self.now, hot_event_ids=self.hot_event_ids)
            if self.materialize:
                ensure_checkpoint_dir(self.spark)
                df = df.checkpoint(eager=True)
            return df

        return self._get("classified", build)

    @property
    def accepted(self) -> DataFrame:
        return self._get("accepted", lambda: classify.accepted_events(self.classified))

    @property
    def rejected(self) -> DataFrame:
        return self._get("rejected", lambda: classify.rejected_events(self.classified, now=self.now))

    @property
    def fact(self) -> DataFrame:
        return self._get("fact", lambda: publish.fact_rows(self.accepted, now=self.now))

    @property
    def dim_users(self) -> DataFrame:
        return self._get("dim_users", lambda: publish.dim_users(self.accepted, now=self.now))

    @property
    def mart(self) -> DataFrame:
        return self._get("mart", lambda: publish.daily_event_mart(self.fact, now=self.now))
