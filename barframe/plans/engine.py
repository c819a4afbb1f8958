"""Runs studies: a study is a function of bars and parameters that returns a report."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import align, drawing, output, recursive, strategy, ta
from ..operators.frame import BarFrame
from ..sources import bars as sources
from .parameters import Parameters

Study = Callable[[BarFrame, Parameters], output.Report]


@dataclass(frozen=True)
class Limits:
    max_bars: int | None = None
    max_outputs: int | None = None
    max_lines: int | None = None


class Engine:
    def __init__(self, spark: SparkSession, limits: Limits = Limits()):
        self.spark, self.limits = spark, limits

    def bars(self, source, **options) -> BarFrame:
        """Admitted bars; a bad one fails the plan that reads it."""
        good, _ = sources.admit(sources.read_bars(self.spark, source, **options), strict=True)
        if self.limits.max_bars is not None:
            good = sources.within_budget(good, self.limits.max_bars)
        return BarFrame(good).together()

    def run(self, study: Study, source, params: Mapping[str, Any] | None = None, **options) -> output.Report:
        """The study's report, as lazy tables."""
        given = Parameters(params or {})
        report = study(source if isinstance(source, BarFrame) else self.bars(source, **options), given)
        if given.unused():
            raise ValueError(f"no such parameters: {sorted(given.unused())}")
        if self.limits.max_outputs is not None and len(report.tables) > self.limits.max_outputs:
            raise ValueError(f"more than {self.limits.max_outputs} outputs")
        return report

    def validate(self, study: Study, params: Mapping[str, Any] | None = None) -> list[str]:
        """What is wrong with a study: its plans are built on an empty table and analysed, not run."""
        empty = BarFrame(self.spark.createDataFrame([], sources.BAR_SCHEMA))
        try:
            report = self.run(study, empty, params)
            for df in report.tables.values():
                df.schema  # noqa: B018  analysis happens here
        except Exception as e:  # the message is the result
            return [f"{type(e).__name__}: {e}"]
        return []

    def parameters(self, study: Study) -> list[dict]:
        """The parameters that a study declares."""
        given = Parameters()
        study(BarFrame(self.spark.createDataFrame([], sources.BAR_SCHEMA)), given)
        return given.schema()

    def schema(self) -> dict:
        return {"bars": sources.BAR_SCHEMA.jsonValue(), "outputs": list(output.OUTPUTS), "strategy_events": strategy.EVENTS, "commands": strategy.COMMAND}


def capabilities() -> dict[str, dict[str, str]]:
    """Public operators by module, with their signatures."""
    out = {}
    for module in (ta, recursive, align, strategy, output, drawing):
        names = {n: f for n, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not n.startswith("_")}
        out[module.__name__.rpartition(".")[2]] = {n: str(inspect.signature(f)) for n, f in sorted(names.items())}
    return out


def provider_checks(requested: BarFrame, symbols: list[str], start: int, end: int) -> dict[str, bool]:
    """Whether a table of requested bars behaves: known symbols have bars, an unknown one none, times lie in the range asked for and don't repeat."""
    inside = requested.df.where(F.col(requested.order).between(start, end))
    found = {r[0]: (r[1], r[2]) for r in inside.where(F.col("sym").isin(symbols)).groupBy("sym").agg(F.count("*"), F.count_distinct(requested.order)).collect()}
    return {
        "known symbols have bars": set(found) == set(symbols), "times do not repeat": all(n == d for n, d in found.values()),
        "unknown symbols are empty": inside.where(F.col("sym") == "\0unknown").isEmpty(), "prices are numbers": {t for n, t in requested.df.dtypes if n in sources.PRICES} == {"double"},
    }
