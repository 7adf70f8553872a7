"""Description of one feed: its file, its schema and how its history is keyed."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import types as T

from strandline.functions.casting import MISSING_TOKENS

# Fixed values of the data model.
START_DATE = date(2022, 1, 1)
LANDING_ZONE = "landing"
STAGING_ZONE = "staging"
PARTITION_COLUMN = "dt"
LINEAGE_COLUMNS = ("event_dt", "load_ts")


@dataclass(frozen=True)
class TableSpec:
    """One daily feed; the same jobs serve every feed, only the spec differs."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    order: tuple[str, ...] = (PARTITION_COLUMN,)
    time: str = PARTITION_COLUMN
    ignored: tuple[str, ...] = LINEAGE_COLUMNS
    tie_breaker: tuple[str, ...] = ()
    start: date = START_DATE
    reader_options: dict[str, str] = field(default_factory=dict)
    missing: tuple[str, ...] = MISSING_TOKENS  # texts that stand for no value
    multi_line: bool = False  # whether values in quotes hold line breaks
    file: str | None = None  # the file's name, if it is not that of the table

    @property
    def file_name(self) -> str:
        return self.file or f"{self.name}.csv"

    @property
    def landing_asset(self) -> str:
        return f"{self.name}_asset"

    @property
    def history_asset(self) -> str:
        return f"{self.name}_scd2_asset"


def sample_specs() -> dict[str, TableSpec]:
    """The three sample feeds: one integer key, two text keys, otherwise alike."""

    def spec(name: str, key_type: T.DataType) -> TableSpec:
        schema = T.StructType(
            [
                T.StructField("foo", key_type),
                T.StructField("bar_col", T.LongType()),
                T.StructField("baz_col", T.StringType()),
            ]
        )
        return TableSpec(name=name, schema=schema, key=("foo",))

    return {
        "foo": spec("foo", T.LongType()),
        "bar": spec("bar", T.StringType()),
        "baz": spec("baz", T.StringType()),
    }
