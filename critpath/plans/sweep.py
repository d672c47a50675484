"""Runs of one trace under many settings, as one table each of summaries and paths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.operators import summary
from critpath.plans.pipeline import Analysis


def steps(least: int, most: int, factor: int) -> Iterator[int]:
    """least, least * factor, ... up to most."""
    while least <= most:
        yield least
        least *= factor


@dataclass
class Sweep:
    """Every window with every threshold; results carry both, and are lazy like each run's."""

    trace: DataFrame
    base: Config
    windows: Iterable[int]
    thresholds: Iterable[int]

    def __post_init__(self) -> None:
        self.windows, self.thresholds = list(self.windows), list(self.thresholds)

    def runs(self) -> Iterator[tuple[Config, Analysis]]:
        for window in self.windows:
            for threshold in self.thresholds:
                config = replace(self.base, window=window, threshold=threshold)
                yield config, Analysis.of(self.trace, config)

    def _all(self, what) -> DataFrame:
        frames = {f"{c.window},{c.threshold}": what(run) for c, run in self.runs()}
        both = F.split("experiment", ",")
        return summary.concatenated(frames).withColumns({"window": both[0].cast("long"), "threshold": both[1].cast("long")}).drop("experiment")

    def summaries(self) -> DataFrame:
        return self._all(lambda run: run.summaries)

    def paths(self) -> DataFrame:
        return self._all(lambda run: run.paths)

    def normalised(self, ticks_per_second: int) -> DataFrame:
        return self._all(lambda run: run.normalised(ticks_per_second))
