"""History compression in plain Python, straight from its definition, to test against."""

from __future__ import annotations


def _differs(a, b):
    """Three-valued ``a <> b OR b IS NULL``."""
    if b is None:
        return True
    return None if a is None else a != b


def _any(values):
    found = list(values)
    return True if True in found else None if None in found else False


def compress(records: list[dict], key: str, time: str, compared: list[str], as_of) -> list[dict]:
    result = []
    for value in {r[key] for r in records}:
        rows = sorted((dict(r) for r in records if r[key] == value), key=lambda r: r[time])
        nothing = dict.fromkeys(compared)
        for i, row in enumerate(rows):
            before = rows[i - 1] if i else nothing
            after = rows[i + 1] if i + 1 < len(rows) else nothing
            row["s"] = _any(_differs(row[c], before[c]) for c in compared)
            row["e"] = _any(_differs(row[c], after[c]) for c in compared)
        kept = [r for r in rows if r["s"] or r["e"]]
        for i, row in enumerate(kept):
            following = kept[i + 1][time] if i + 1 < len(kept) else None
            row["valid_to"] = row[time] if row["e"] else following
        starts = [r for r in kept if r["s"]]
        starts[-1]["valid_to"] = as_of
        result += starts
    return result
