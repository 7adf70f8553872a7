"""The nine sample landing files and the histories expected of them."""

from __future__ import annotations

from datetime import date
from pathlib import Path

from strandline.sources.landing import LandingZone

TODAY = date(2030, 1, 1)
DAYS = [date(2022, 1, 1), date(2022, 1, 2), date(2022, 1, 3)]
HEADER = "foo,bar_col,baz_col\n"
FILES = {
    "foo": ['1,1,"A"', '1,1,"A"', "1,1,A"],
    "bar": ["bar,1,A", "bar,2,A", "bar,3,A"],
    "baz": ["baz,1,A\nbaz2,1,A", "baz,1,A\nbaz2,1,A", "baz,5,C\nbaz2,20,B"],
}
ONE, TWO, THREE = DAYS
HISTORY = {
    "foo": [(1, 1, "A", "2022-01-01", ONE, TODAY)],
    "bar": [
        ("bar", 1, "A", "2022-01-01", ONE, ONE),
        ("bar", 2, "A", "2022-01-02", TWO, TWO),
        ("bar", 3, "A", "2022-01-03", THREE, TODAY),
    ],
    "baz": [
        ("baz", 1, "A", "2022-01-01", ONE, TWO),
        ("baz", 5, "C", "2022-01-03", THREE, TODAY),
        ("baz2", 1, "A", "2022-01-01", ONE, TWO),
        ("baz2", 20, "B", "2022-01-03", THREE, TODAY),
    ],
}
HISTORY_COLUMNS = ["foo", "bar_col", "baz_col", "event_dt", "valid_from", "valid_to"]


def deliver(base: Path, table: str, day: date, lines: str | None = None) -> None:
    folder = base / str(day)
    folder.mkdir(parents=True, exist_ok=True)
    text = FILES[table][DAYS.index(day)] if lines is None else lines
    (folder / f"{table}.csv").write_text(HEADER + text)


def sample_zone(base: Path, days=DAYS) -> LandingZone:
    for table in FILES:
        for day in days:
            deliver(base, table, day)
    return LandingZone(str(base))


def rows(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
