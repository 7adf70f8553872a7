"""Keeping a history up to date without rebuilding all of it.

Two ways, both equal to a full run:

* :func:`append_versions` goes on from the last few rows of each key, the tail. Its cost is (keys + new
  rows), however long the history is. :class:`HistoryTable` stores histories this way. It takes late or
  repeated days by going back to the tail before them, and older ones by a repair around them.
* :func:`rebuild_buckets` compresses the keys touched by a delivery anew: keys are hashed to buckets, and
  the buckets touched are read from the landing table and replaced.

Stored versions keep an open flag and no end for the open one, so they do not age;
:func:`current_history` fills the end in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from datetime import date
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.files import child_names, delete_folder, matches
from strandline.functions.changes import compared_columns
from strandline.functions.dates import directory_value
from strandline.operators.history import (
    END,
    FOLLOWING,
    PREVIOUS,
    START,
    AsOf,
    flag_columns,
    kept_rows,
    key_window,
    with_neighbours,
)
from strandline.operators.repair import BEFORE, FROM, inside, rows_to_compress, windows, without_keys
from strandline.operators.slicing import (
    ROWS_PER_SLICE,
    Flag,
    Sliced,
    close_in_slices,
    compress_history_sliced,
    kept_in_slices,
    split_heavy,
    tail_of_slices,
)
from strandline.scratch import stored
from strandline.sources.manifest import Manifest
from strandline.sources.warehouse import Warehouse, Written, quoted
from strandline.spec import PARTITION_COLUMN

BUCKET, OPEN = "bucket", "is_open"
BUCKETS = 1024
KNOWN, LAST = "__known", "__last"
PART, CLOSED, TAIL = "part", "closed", "tail"


def no_end() -> Column:
    return F.lit(None)


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """Bucket number of a key, stable across runs."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched_buckets(batch: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets a batch has keys of: at most ``buckets`` rows."""
    return batch.select(bucket_of(key, buckets).alias(BUCKET)).distinct()


def land_in_buckets(
    warehouse: Warehouse, name: str, zone: str, batch: DataFrame, key: Sequence[str], buckets: int = BUCKETS
) -> list[int]:
    """Replace the days of ``batch`` in a copy of the landing rows that is laid out by bucket and then by day.

    Returns the buckets touched: those that have rows of these days now, or had some before.
    """
    rows = batch.withColumn(BUCKET, bucket_of(key, buckets))
    # At most one row per bucket and day delivered.
    now = {tuple(r) for r in rows.select(BUCKET, PARTITION_COLUMN).distinct().collect()}
    path = warehouse.path(name, zone)
    before = set()
    for day in {day for _, day in now}:
        for folder in matches(warehouse.spark, f"{path}/{BUCKET}=*/{PARTITION_COLUMN}={day}"):
            before.add((int(folder.rsplit(f"/{BUCKET}=", 1)[1].split("/")[0]), day))
    warehouse.write_partitioned(rows, name, zone, by=(BUCKET, PARTITION_COLUMN), even_files=True)
    for bucket, day in before - now:  # the write replaces only folders that it has rows for
        delete_folder(warehouse.spark, f"{path}/{BUCKET}={bucket}/{PARTITION_COLUMN}={day}")
    return sorted({bucket for bucket, _ in before | now})


def rows_of_buckets(
    rows: DataFrame, touched: DataFrame | Sequence[int] | None, key: Sequence[str], buckets: int
) -> DataFrame:
    """``rows`` of the touched buckets, with their bucket. Rows laid out by bucket are read from those folders only."""
    if BUCKET not in rows.columns:
        rows = rows.withColumn(BUCKET, bucket_of(key, buckets))
    if isinstance(touched, DataFrame):
        touched = [r[0] for r in touched.collect()]  # at most one row per bucket
    return rows if touched is None else rows.filter(F.col(BUCKET).isin(list(touched)))


def rebuild_buckets(
    warehouse: Warehouse,
    name: str,
    zone: str,
    rows: DataFrame,
    touched: DataFrame | Sequence[int] | None,
    key: Sequence[str],
    order: Sequence[str],
    time: str,
    ignored: Sequence[str] = (),
    *,
    null_mode: str = "reference",
    tie_breaker: Sequence[str] = (),
    buckets: int = BUCKETS,
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> Written:
    """Compress the touched buckets (all, if None) of ``rows`` anew and replace them in the stored history.

    ``rows`` is the whole landing table; its other buckets are dropped before anything is shuffled, and not even
    read where it is the copy that :func:`land_in_buckets` keeps.
    ``rows_per_slice`` None skips the look for heavy keys, for rows known to be one per key and day.
    """
    rows = rows_of_buckets(rows, touched, key, buckets)
    history = compress_history_sliced(
        rows,
        key,
        order,
        time,
        [*ignored, BUCKET],
        as_of=no_end(),
        null_mode=null_mode,
        tie_breaker=tie_breaker,
        open_flag=OPEN,
        rows_per_slice=rows_per_slice,
    )
    return warehouse.write_partitioned(history, name, zone, by=BUCKET, even_files=True)


def current_history(versions: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Stored versions as a history: the open ones end at ``as_of``, today if not given."""
    end = F.current_date() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    end = end.cast(versions.schema["valid_to"].dataType)
    closed = F.when(F.col(OPEN), end).otherwise(F.col("valid_to"))
    return versions.withColumn("valid_to", closed).drop(OPEN, BUCKET)


def flag_after_tail(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], compared: Sequence[str], null_mode: str
) -> DataFrame:
    """Flags for new rows and the tail's rows.

    A tail row's start flag is final, and so is its end flag once a row follows it. Only the last row
    of a key waits for its follower.
    """
    start, end = flag_columns(compared, null_mode)
    flags = {
        START: F.when(F.col(KNOWN), F.col(START)).otherwise(start),
        END: F.when(F.col(LAST), end).otherwise(F.col(END)),
        LAST: F.col(LAST) & F.col(FOLLOWING).isNull(),
    }
    return with_neighbours(rows, key, order, compared).withColumns(flags).drop(PREVIOUS, FOLLOWING, KNOWN)


def after_tail(tail: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The tail's rows and the new ones, not flagged yet."""
    unknown = F.lit(None).cast("boolean")
    fresh = batch.withColumns({START: unknown, END: unknown, LAST: F.lit(True), KNOWN: F.lit(False)})
    return fresh if tail is None else tail.withColumn(KNOWN, F.lit(True)).unionByName(fresh)


def settle(kept: DataFrame, key: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """Sort the kept rows out: versions that are closed, and each key's rows from its last start on.

    The latter are the tail, at most three rows: the start, the last and the one before. Both come out of
    one pass, told apart by the column ``part``; all else is dropped.
    """
    in_order = key_window(key, order)
    # Places in the order, not its values: of rows that tie, only one is the last start.
    placed = kept.withColumns({"__next": F.lead(time).over(in_order), "__n": F.row_number().over(in_order)})
    placed = placed.withColumns(
        {
            "valid_to": F.when(F.col(END), F.col(time)).otherwise(F.col("__next")),
            "__from": F.max(F.when(F.col(START), F.col("__n"))).over(Window.partitionBy(*key)),
        }
    )
    part = F.when(F.col("__n") >= F.col("__from"), F.lit(TAIL)).when(F.col(START), F.lit(CLOSED))
    return placed.withColumn(PART, part).drop("__from", "__n", "__next").filter(F.col(PART).isNotNull())


def settle_in_slices(sliced: Sliced, key: Sequence[str], time: str, flag: Flag) -> DataFrame:
    """The same for keys with more rows than one task should take."""
    kept = kept_in_slices(sliced, key, flag)
    versions = close_in_slices(kept.drop(LAST), sliced.pairs, key, time, no_end(), OPEN)
    closed = versions.filter(~F.col(OPEN)).drop(OPEN).withColumnRenamed("valid_from", time)
    flags = {START: F.lit(True), END: F.lit(None).cast("boolean"), LAST: F.lit(False), PART: F.lit(CLOSED)}
    no_valid_to = F.lit(None).cast(kept.schema[time].dataType)
    tail = tail_of_slices(kept, key).withColumns({"valid_to": no_valid_to, PART: F.lit(TAIL)})
    return closed.withColumns(flags).unionByName(tail)


def closed_versions(settled: DataFrame, time: str) -> DataFrame:
    """The closed versions in stored form."""
    rows = settled.filter(F.col(PART) == CLOSED).withColumn(OPEN, F.lit(False))
    return rows.withColumnRenamed(time, "valid_from").drop(START, END, LAST, PART)


def tail_rows(settled: DataFrame) -> DataFrame:
    """What the next batch needs of each key."""
    return settled.filter(F.col(PART) == TAIL).drop("valid_to", PART)


def open_versions(tail: DataFrame, time: str) -> DataFrame:
    """The open version of each key in stored form: the one start row its tail has."""
    rows = tail.filter(START).withColumns({"valid_to": F.lit(None).cast(tail.schema[time].dataType), OPEN: F.lit(True)})
    return rows.withColumnRenamed(time, "valid_from").drop(START, END, LAST)


def append_versions(
    tail: DataFrame | None,
    batch: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    time: str,
    ignored: Sequence[str] = (),
    *,
    null_mode: str = "reference",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """The versions closed by a batch that is later than the tail, and the tail after it, in one frame.

    Take them out with :func:`closed_versions` and :func:`tail_rows`. Closed versions are final: over all
    batches, each comes out once. ``rows_per_slice`` turns on the look for keys with more rows than one
    task should take.
    """
    compared = compared_columns(batch, key, order, ignored)
    flag = partial(flag_after_tail, compared=compared, null_mode=null_mode)
    light, sliced = split_heavy(after_tail(tail, batch), key, order, rows_per_slice)
    settled = settle(kept_rows(flag(light, key, order)), key, order, time)
    return settled if sliced is None else settled.unionByName(settle_in_slices(sliced, key, time, flag))


class HistoryTable:
    """A stored history that grows by days.

    Every change adds a folder, the state: in ``part=closed`` the versions it closed, in ``part=tail`` the tail after
    it. The manifest lists the states in force, and switches from one list to the next at once; nothing that it names,
    or that the one before it named, is ever deleted. So a job may die at any step, and be repeated.

    New days go on from the newest tail before them. Days older than all tails kept are repaired around them, see
    :mod:`strandline.operators.repair`: the state then also holds the windows whose older versions no longer count.
    """

    def __init__(
        self,
        warehouse: Warehouse,
        name: str,
        zone: str,
        key: Sequence[str],
        order: Sequence[str],
        time: str,
        ignored: Sequence[str] = (),
        *,
        null_mode: str = "reference",
        rows_per_slice: int | None = ROWS_PER_SLICE,
        tails: int = 8,
    ):
        self.warehouse, self.spark = warehouse, warehouse.spark
        self.name, self.zone = name, zone
        self.key, self.order, self.time, self.ignored = list(key), list(order), time, list(ignored)
        self.null_mode, self.rows_per_slice, self.tails = null_mode, rows_per_slice, tails
        self.manifest = Manifest(self.spark, f"{self.path}/_manifest")

    @property
    def path(self) -> str:
        return self.warehouse.path(self.name, self.zone)

    def states(self) -> list[dict[str, Any]]:
        """The states in force, oldest first."""
        _, content = self.manifest.newest()
        return content["states"] if content else []

    def through(self) -> list[int]:
        """Days that can be gone back to, as directory numbers; the last one is the current state."""
        return [s["through"] for s in self.states() if s["tail_kept"]]

    def update(
        self,
        rows: DataFrame,
        first: date,
        last: date,
        days: Sequence[date] | None = None,
        replaced: DataFrame | None = None,
    ) -> int:
        """Take in the days from ``first`` on, new or delivered again; return the number of versions.

        ``rows`` is the whole landing table up to ``last``, of which only the days after the newest tail
        before ``first`` are read. Without such a tail it is all of them; if ``days`` names those that changed, only
        what they touch. ``replaced`` then has key and time of the rows that these days had before.
        """
        if not isinstance(rows.schema[self.time].dataType, T.DateType):
            raise TypeError(f"{self.time} is no date, so days need not come in its order; use rebuild_buckets")
        number, content = self.manifest.newest()
        states = content["states"] if content else []
        base = max((i for i, s in enumerate(states) if s["tail_kept"] and s["through"] < directory_value(first)), default=None)
        if base is None and states and days and self.order == [self.time]:
            known = states[-1]["through"]
            late = [d for d in days if directory_value(d) <= known]
            fresh = [d for d in days if directory_value(d) > known]
            versions = self._repair(number, states, rows, late, replaced)
            return self.update(rows, min(fresh), last) if fresh else versions
        batch = rows.filter(F.col(self.time) <= F.lit(last))
        tail = None
        if base is not None:
            tail = self._tail(content, states[base])
            batch = batch.filter(F.col(self.time) > F.lit(_day(states[base]["through"])))
        # Ordered by the date alone, a key has one row a day, so the calendar bounds it.
        size = None if self.order == [self.time] else self.rows_per_slice
        settled = append_versions(
            tail, batch, self.key, self.order, self.time, self.ignored, null_mode=self.null_mode, rows_per_slice=size
        )
        kept = [] if base is None else states[: base + 1]
        state = self._write(number, settled, directory_value(last))
        state["closed_so_far"] = state["closed"] + (kept[-1]["closed_so_far"] if kept else 0)
        return self._switch(number, [*kept, state], settled.schema)

    def _repair(
        self, number: int, states: list[dict[str, Any]], rows: DataFrame, days: Sequence[date], replaced: DataFrame | None
    ) -> int:
        content = self.manifest.read(number)
        known = rows.filter(F.col(self.time) <= F.lit(_day(states[-1]["through"])))
        touched = known.filter(F.col(self.time).isin(list(days))).select(*self.key, self.time)
        if replaced is not None:
            touched = touched.unionByName(replaced.select(*self.key, self.time))
        # Read by four plans below, and the versions it comes from are about to change.
        within = stored(windows(self.versions(), touched, self.key, self.time), "windows")
        local = rows_to_compress(known, within, self.key, self.time)
        settled = append_versions(
            None, local, self.key, self.order, self.time, [*self.ignored, BEFORE], null_mode=self.null_mode
        )
        # The start that a window stops at is a version of its own, and has not changed.
        settled = settled.filter((F.col(PART) == CLOSED) | F.col(BEFORE).isNull()).drop(BEFORE)
        others = without_keys(self._tail(content, states[-1]), within.filter(F.col(BEFORE).isNull()), self.key)
        no_end = F.lit(None).cast(others.schema[self.time].dataType)
        settled = settled.unionByName(others.withColumns({"valid_to": no_end, PART: F.lit(TAIL)}))
        closed = closed_versions(self._closed(content, states), self.time)
        gone = inside(closed, within, self.key, "valid_from", "left_semi", closed=False).count()
        state = self._write(number, settled, states[-1]["through"], within)
        state["closed_so_far"] = states[-1]["closed_so_far"] - gone + state["closed"]
        # Older tails lack the late days.
        kept = [{**s, "tail_kept": False} for s in states]
        versions = self._switch(number, [*kept, state], settled.schema)
        if sum(s["gone"] for s in kept) >= self.tails:
            self.compact()
        return versions

    def compact(self) -> None:
        """Make one state of all, so that reading takes no look at what repairs have replaced."""
        number, content = self.manifest.newest()
        states = content["states"]
        tail = self._tail(content, states[-1])
        no_end = F.lit(None).cast(tail.schema[self.time].dataType)
        every = self._closed(content, states).unionByName(tail.withColumns({"valid_to": no_end, PART: F.lit(TAIL)}))
        state = self._write(number, every, states[-1]["through"])
        self._switch(number, [{**state, "closed_so_far": state["closed"]}], every.schema)

    def _write(self, number: int, settled: DataFrame, through: int, gone: DataFrame | None = None) -> dict[str, Any]:
        """Write a state that no manifest names yet."""
        name = f"{number + 1:012}-{uuid.uuid4().hex}"
        part = F.col(PART)
        counts = {
            "closed": F.count_if(part == CLOSED),
            "tail": F.count_if(part == TAIL),
            "open": F.count_if((part == TAIL) & F.col(START)),
        }
        written = self.warehouse.write_folder(settled, f"{self.path}/{name}", (PART,), counts, even_files=True)
        if gone is not None:
            self.warehouse.write_folder(gone, f"{self.path}/{name}-gone")
        return {"name": name, "through": through, "gone": gone is not None, "tail_kept": True, **written.metrics}

    def _switch(self, number: int, states: list[dict[str, Any]], schema: T.StructType) -> int:
        """Put ``states`` in force, then delete what neither they nor the states before them need."""
        with_tail = [s["name"] for s in states if s["tail_kept"]][-self.tails :]
        states = [{**s, "tail_kept": s["name"] in with_tail} for s in states]
        self.manifest.switch(number, {"schema": schema.json(), "states": states})
        self.register_view()
        self._clean()
        return states[-1]["closed_so_far"] + states[-1]["open"]

    def _clean(self) -> None:
        named = [s for content in self.manifest.forget() for s in content["states"]]
        folders = {s["name"] for s in named} | {f"{s['name']}-gone" for s in named}
        for name in child_names(self.spark, self.path):
            if not name.startswith(("_", ".")) and name not in folders:
                delete_folder(self.spark, f"{self.path}/{name}")
        tails = {s["name"] for s in named if s["tail_kept"]}
        for name in {s["name"] for s in named} - tails:
            delete_folder(self.spark, f"{self.path}/{name}/{PART}={TAIL}")

    def _read(self, content: dict[str, Any], part: str, states: Sequence[dict[str, Any]]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        paths = [f"{self.path}/{s['name']}/{PART}={part}" for s in states if s[part]]
        own = T.StructType([f for f in schema if f.name != PART])
        found = self.spark.read.schema(own).parquet(*paths) if paths else self.spark.createDataFrame([], own)
        return found.withColumn(PART, F.lit(part))

    def _tail(self, content: dict[str, Any], state: dict[str, Any]) -> DataFrame:
        return tail_rows(self._read(content, TAIL, [state]))

    def _closed(self, content: dict[str, Any], states: Sequence[dict[str, Any]]) -> DataFrame:
        """The closed rows in force: those of each state that no later repair has replaced."""
        found = None
        for group, gone in _runs(states):
            if gone is not None and found is not None:
                within = self.spark.read.parquet(f"{self.path}/{gone}-gone")
                found = inside(found, within, self.key, self.time, "left_anti", closed=False)
            more = self._read(content, CLOSED, group)
            found = more if found is None else found.unionByName(more)
        return found

    def versions(self) -> DataFrame:
        """All versions in stored form."""
        _, content = self.manifest.newest()
        if content is None:
            raise ValueError(f"the history {self.name} has no state yet; update it first")
        states = content["states"]
        closed = closed_versions(self._closed(content, states), self.time)
        return closed.unionByName(open_versions(self._tail(content, states[-1]), self.time))

    def read(self, as_of: AsOf = None) -> DataFrame:
        """The history, its open versions ending at ``as_of``."""
        return current_history(self.versions(), as_of)

    def register_view(self) -> None:
        """View of the current state in which open versions end today, whenever it is read."""
        self.warehouse.create_zone(self.zone)
        _, content = self.manifest.newest()
        states = content["states"]
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        names = [f.name for f in schema if f.name not in (START, END, LAST, PART, self.time, "valid_to")]
        columns = ", ".join(f"{quoted(c)}" for c in [*names, self.time, "valid_to"])
        closed = None
        for group, gone in _runs(states):
            if gone is not None and closed is not None:
                same = " AND ".join(f"v.{quoted(c)} <=> g.{quoted(c)}" for c in self.key)
                at = f"v.{quoted(self.time)}"
                closed = (
                    f"SELECT v.* FROM ({closed}) v LEFT ANTI JOIN parquet.{quoted(f'{self.path}/{gone}-gone')} g ON {same} "
                    f"AND {at} >= g.{FROM} AND (g.{BEFORE} IS NULL OR {at} < g.{BEFORE})"
                )
            there = ",".join(s["name"] for s in group if s["closed"])
            if there:
                more = f"SELECT {columns} FROM parquet.{quoted(f'{self.path}/{{{there}}}/{PART}={CLOSED}')}"
                closed = more if closed is None else f"{closed} UNION ALL {more}"
        outer = ", ".join([*map(quoted, names), f"{quoted(self.time)} AS valid_from"])
        parts = [] if closed is None else [f"SELECT {outer}, valid_to FROM ({closed})"]
        if states[-1]["open"]:
            tail = quoted(f"{self.path}/{states[-1]['name']}/{PART}={TAIL}")
            parts.append(f"SELECT {outer}, current_date() AS valid_to FROM parquet.{tail} WHERE {quoted(START)}")
        if not parts:
            empty = ", ".join(f"CAST(NULL AS {schema[c].dataType.simpleString()}) AS {quoted(c)}" for c in [*names, self.time, "valid_to"])
            parts = [f"SELECT {outer}, valid_to FROM (SELECT {empty}) WHERE false"]
        view = self.warehouse.table_name(self.name, self.zone)
        self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS {' UNION ALL '.join(parts)}")


def _day(through: int) -> date:
    return date(through // 10000, through // 100 % 100, through % 100)


def _runs(states: Sequence[dict[str, Any]]) -> Iterator[tuple[list[dict[str, Any]], str | None]]:
    """States cut before each repair, with the name of the repair that a run begins with."""
    run: list[dict[str, Any]] = []
    for state in states:
        if state["gone"] and run:
            yield run, run[0]["name"] if run[0]["gone"] else None
            run = []
        run.append(state)
    if run:
        yield run, run[0]["name"] if run[0]["gone"] else None
