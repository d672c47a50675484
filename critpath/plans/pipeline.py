"""The whole analysis as one plan: trace, graph, ranking, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.operators import pag, prep, rank, summary


@dataclass
class Analysis:
    """Lazily computed results; what isn't asked for never runs."""

    trace: DataFrame
    graph: DataFrame
    config: Config

    @classmethod
    def of(cls, trace: DataFrame, config: Config) -> Analysis:
        return cls(trace, pag.construct(trace, config), config)

    @property
    def ranked(self) -> DataFrame:
        return rank.betweenness(self.graph)

    @property
    def summaries(self) -> DataFrame:
        return summary.summarise(self.ranked, self.config.window, self.config.wide_operators)

    @property
    def paths(self) -> DataFrame:
        return rank.path_counts_at_start(self.ranked, self.config.window)

    def path_summaries(self, seed: int = 0, pick: str = "random") -> DataFrame:
        return summary.summarise_path(rank.single_path(self.graph, seed, pick))

    def normalised(self, ticks_per_second: int) -> DataFrame:
        sliced = prep.with_epoch(prep.clip_message_delay(self.trace, self.config.message_delay), self.config.window)
        origin = sliced.agg(F.min("epoch").alias("epoch"))
        return summary.normalised_once(self.ranked, origin, self.config.window, ticks_per_second, self.config.wide_operators)
