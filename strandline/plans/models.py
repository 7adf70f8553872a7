"""SQL models: plain Spark SQL over zone tables, built in dependency order as tables or views."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from strandline.operators.quality import run_checks
from strandline.sources.warehouse import Warehouse, Written


@dataclass(frozen=True)
class Model:
    """A query over sources and other models; ``{name}`` in the SQL stands for the table ``name``."""

    name: str
    sql: str
    needs: tuple[str, ...] = ()
    materialized: str = "view"
    checks: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.materialized not in ("view", "table"):
            raise ValueError(f"model {self.name}: materialized must be view or table, not {self.materialized!r}")


class Models:
    """Sources and models of one warehouse. Models go to ``zone``; a source may be in any zone."""

    def __init__(self, warehouse: Warehouse, zone: str | None = None):
        self.warehouse = warehouse
        self.zone = zone or warehouse.default_zone
        self.sources: dict[str, str] = {}
        self.models: dict[str, Model] = {}

    def source(self, name: str, zone: str | None = None) -> None:
        self.sources[name] = self.warehouse.table_name(name, zone)

    def add(self, *models: Model) -> None:
        for model in models:
            self.models[model.name] = model

    def table_name(self, name: str) -> str:
        if name in self.models:
            return self.warehouse.table_name(name, self.zone)
        if name in self.sources:
            return self.sources[name]
        raise KeyError(f"no source or model is named {name!r}")

    def order(self) -> list[str]:
        """Model names, each after the ones it needs."""
        graph = {m.name: {n for n in m.needs if n in self.models} for m in self.models.values()}
        return list(TopologicalSorter(graph).static_order())

    def sql(self, name: str) -> str:
        model = self.models[name]
        return model.sql.format(**{need: self.table_name(need) for need in model.needs})

    def build(self, names: Iterable[str] | None = None) -> dict[str, Written | None]:
        """Build models in order. A table reports what was written; a view writes nothing: None."""
        wanted = set(self.models if names is None else names)
        self.warehouse.create_zone(self.zone)
        return {name: self._build(self.models[name]) for name in self.order() if name in wanted}

    def _build(self, model: Model) -> Written | None:
        if model.materialized == "view":
            self.warehouse.spark.sql(f"CREATE OR REPLACE VIEW {self.table_name(model.name)} AS {self.sql(model.name)}")
            return None
        written = self.warehouse.write_table(self.warehouse.spark.sql(self.sql(model.name)), model.name, self.zone)
        self.warehouse.register_view(model.name, self.zone)
        return written

    def read(self, name: str) -> DataFrame:
        return self.warehouse.spark.table(self.table_name(name))

    def check(self) -> DataFrame:
        """Failures of every check of every model."""
        checks = [(m.name, column, check) for m in self.models.values() for column, check in m.checks]
        return run_checks({name: self.read(name) for name in self.models}, checks)


# The two example models and the checks on them.
EXAMPLE_CHECKS = (("id", "unique"), ("id", "not_null"))


def example_models(source: str) -> tuple[Model, Model]:
    """First: every source row with a constant id, as a table. Second: the rows with id 1, as a view."""
    first = Model(
        name="model_first",
        sql=f"SELECT *, 1 AS id FROM {{{source}}}",
        needs=(source,),
        materialized="table",
        checks=EXAMPLE_CHECKS,
    )
    second = Model(
        name="model_second",
        sql="SELECT * FROM {model_first} WHERE id = 1",
        needs=("model_first",),
        checks=EXAMPLE_CHECKS,
    )
    return first, second
