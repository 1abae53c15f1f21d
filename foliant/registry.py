"""The queries this library offers: a name, a builder and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Collects builders and SQL under one name each."""

    builders: dict[str, Builder] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, builder: Builder, sql: str | None = None) -> None:
        """Register `builder` as `name`; `sql` is its DuckDB equivalent, if there is one."""
        if name in self.builders:
            raise ValueError(f"{name} is registered already")
        self.builders[name] = builder
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        """Decorator form of `add`."""

        def keep(builder: Builder) -> Builder:
            self.add(name, builder, sql)
            return builder

        return keep

    def include(self, other: Registry) -> None:
        """Add all queries of `other`."""
        for name, build in other.builders.items():
            self.add(name, build, other.sql.get(name))
