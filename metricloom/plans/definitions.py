"""Reusable metric definitions: SQL metrics with bound arguments, rebinding by column name, pinned versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metricloom.plans.store import ReportedMetric, report_rows, to_long


def sql_metric(spark: SparkSession, sql: str, *, datasets: Mapping[str, DataFrame],
               columns: Mapping[str, str] | None = None, literals: Mapping[str, object] | None = None) -> DataFrame:
    """Run user SQL: ``{dataset}`` for tables, ``IDENTIFIER(:arg)`` for columns, ``:arg`` for literals.

    Arguments are bound as parameters, never pasted into the text.
    """
    missing = [
        f"{arg}={name}"
        for arg, name in (columns or {}).items()
        if not any(name in d.columns for d in datasets.values())
    ]
    if missing:
        raise ValueError(f"columns not found in any dataset: {', '.join(missing)}")
    return spark.sql(sql, args={**(columns or {}), **(literals or {})} or None, **datasets)


@dataclass(frozen=True)
class MetricDefinition:
    """A named, versioned metric: a function of (dataset, arguments) and the series it reports."""

    name: str
    compute: Callable[..., DataFrame]
    column_args: Sequence[str]
    reports: Sequence[ReportedMetric]
    literal_args: Mapping[str, object] = field(default_factory=dict)
    version: int = 1
    description: str = ""


@dataclass(frozen=True)
class Binding:
    """A definition applied to a data set: which column each argument reads."""

    definition: MetricDefinition
    columns: Mapping[str, str]
    literals: Mapping[str, object] = field(default_factory=dict)
    segmentation: Sequence[str] = ()

    def frame(self, df: DataFrame) -> DataFrame:
        arguments = {**self.definition.literal_args, **self.literals, **self.columns}
        if self.segmentation:
            arguments["group_by"] = list(self.segmentation)
        return self.definition.compute(df, **arguments)

    def points(self, df: DataFrame, *, model_id: str) -> DataFrame:
        """Store rows; segmentation columns become dimensions."""
        reports = [
            replace(r, dimensions=(*r.dimensions, *self.segmentation)) for r in self.definition.reports
        ]
        return to_long(self.frame(df), reports, model_id=model_id)


    def stored_rows(self, df: DataFrame, *, model_id: str, bucket: str = "5 minutes") -> dict[str, DataFrame]:
        """Store rows of each kind, for a definition whose frame holds single rows."""
        reports = [replace(r, dimensions=(*r.dimensions, *self.segmentation)) for r in self.definition.reports]
        return report_rows(self.frame(df), reports, model_id=model_id, bucket=bucket)


def rebind(binding: Binding, schema: StructType, mapping: Mapping[str, str] | None = None) -> Binding | None:
    """The same binding for another data set, matching columns by name; None when one is gone."""
    mapping = mapping or {}
    names = set(schema.names)
    columns = {arg: mapping.get(c, c) for arg, c in binding.columns.items()}
    segmentation = [mapping.get(c, c) for c in binding.segmentation]
    if not names.issuperset([*columns.values(), *segmentation]):
        return None
    return replace(binding, columns=columns, segmentation=tuple(segmentation))


class DefinitionRegistry:
    """Definitions by name and version; consumers may pin a version."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, int], MetricDefinition] = {}

    def register(self, definition: MetricDefinition) -> None:
        key = (definition.name, definition.version)
        if key in self._known:
            raise ValueError(f"{definition.name} version {definition.version} is already registered")
        self._known[key] = definition

    def get(self, name: str, version: int | None = None) -> MetricDefinition:
        versions = [v for n, v in self._known if n == name]
        if not versions or (version is not None and version not in versions):
            raise KeyError(f"unknown definition {name} version {version}")
        return self._known[name, version if version is not None else max(versions)]
