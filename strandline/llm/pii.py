"""Personal data: fixed patterns, and a character tagger trained on what they label.

Base spans are the leftmost non-overlapping matches of one pattern per kind that pass the kind's test. A bounded sample
of windows around them, and around other digits, trains a bidirectional LSTM with CRF transitions in numpy. It then
reads all windows of all texts that hold a digit or an @, which every kind has: windows of 64 characters every 32, so
that each character is seen twice. Where windows overlap their scores are averaged, and one path is decoded over each
stretch of overlapping windows, so no span is cut at a window's edge. Confident spans that touch no base span are added.

The sample is at most SAMPLE windows per class, and of a text at most SPANS_OF_A_TEXT, the lowest by hash whatever their
kind; these bounds are the operator's documented parameters.

Edge cases: null and empty texts have no spans; repeated rows are each searched; texts of any length are searched
whole, and no pattern takes more than linear time; without any base span nothing is trained and nothing added; an
empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.frames import map_texts, text_of
from strandline.llm.tagger import CHARACTERS, Tagger
from strandline.scratch import stored

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 64, 32
SAMPLE = 400
SPANS_OF_A_TEXT = 8  # that give a window to the sample
SURE = 0.9
# The base patterns. Possessive digits match the same and keep long digit runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ with a domain, back over the characters before it, at most to the last match's end."""
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base spans, by kind and then by start."""
    if not TRIGGER.search(text):
        return []
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(digits := "".join(DIGIT.findall(m[0]))) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, CHARACTERS - 1).astype(np.int64)


def gold_tags(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Per character: 0, or 1 + 2k where a span of kind k begins and 2 + 2k inside it."""
    tags = np.zeros(size, np.int8)
    for kind, start, end in spans:
        tags[start:end] = 2 + 2 * KINDS.index(kind)
        tags[start] -= 1
    return tags


def sample_windows(docs: DataFrame, text: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``sample`` windows per kind, and twice as many around other digits: codes and tags."""
    source = docs.select(text_of(text).alias("text"))

    def work(batch: pa.RecordBatch) -> list | None:
        rows: list[tuple] = []
        for content in batch.column("text").to_pylist():
            if not TRIGGER.search(content):
                continue
            spans = base_spans(content)
            tags = gold_tags(len(content), spans)
            marked = [(KINDS.index(k), s) for k, s, _ in spans]
            other = next((m.start() for m in TRIGGER.finditer(content) if not tags[m.start()]), None)
            if other is not None:
                marked.append((len(KINDS), other))
            around = lambda kind, place: xxhash.xxh64_intdigest(content[max(0, place - 40) : place + 40].encode("utf-8", "surrogatepass"), kind) >> 1
            # A window of each, of at most SPANS_OF_A_TEXT of a text, the lowest by hash as in the sample itself.
            for seed, kind, place in sorted((around(k, p), k, p) for k, p in marked)[:SPANS_OF_A_TEXT]:
                start = max(0, min(place - seed % 40, len(content) - WINDOW))
                part = content[start : start + WINDOW].ljust(WINDOW)
                rows.append((seed, kind, part, bytes(tags[start : start + WINDOW]).ljust(WINDOW, b"\0")))
        if not rows:
            return None
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.binary())]

    found = stored(map_texts(source, "text", "seed bigint, kind int, part string, tags binary", work), "windows")
    x, y = [], []
    for kind in range(len(KINDS) + 1):
        for row in found.filter(F.col("kind") == kind).distinct().orderBy("seed", "part").limit(sample * (1 + (kind == len(KINDS)))).collect():
            x.append(codes(row["part"])[:WINDOW])
            y.append(np.frombuffer(row["tags"], np.int8).astype(np.int64))
    none = np.zeros((0, WINDOW), np.int64)
    return (np.stack(x), np.stack(y)) if x else (none, none)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A tagger, or None if the sample has no base span."""
    x, y = sample_windows(docs, text, sample)
    if not y.any():
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(x, y)
    return tagger


def stretches(text: str) -> list[tuple[int, int]]:
    """First and last window of each stretch of windows that hold a trigger; window i begins at STEP * i."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, (m.start() - WINDOW) // STEP + 1), m.start() // STEP
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Confident spans of each text."""
    owners, firsts, counts, windows = [], [], [], []
    for row, text in enumerate(texts):
        parts = stretches(text) if TRIGGER.search(text) else []
        if not parts:
            continue
        all_codes = codes(text)
        padded = np.r_[all_codes, np.full(WINDOW, 32)]
        for low, high in parts:
            owners.append(row)
            firsts.append(low * STEP)
            counts.append(high - low + 1)
            windows += [padded[i * STEP : i * STEP + WINDOW] for i in range(low, high + 1)]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not windows:
        return found
    scores = np.concatenate([tagger.emissions(np.stack(windows[i : i + 2048])) for i in range(0, len(windows), 2048)])
    begin = np.r_[0, np.cumsum(counts)]
    order = np.argsort(counts, kind="stable").tolist()
    for some in (order[i : i + 256] for i in range(0, len(order), 256)):
        sizes = np.array([(counts[k] - 1) * STEP + WINDOW for k in some])
        joint = np.zeros((len(some), sizes.max(), tagger.tags), np.float32)
        seen = np.zeros((len(some), sizes.max(), 1), np.float32)
        for j, k in enumerate(some):
            for w in range(counts[k]):
                joint[j, w * STEP : w * STEP + WINDOW] += scores[begin[k] + w]
                seen[j, w * STEP : w * STEP + WINDOW] += 1
        joint /= np.maximum(seen, 1)
        path = tagger.best_path(joint, sizes)
        chance = np.exp(joint - joint.max(2, keepdims=True))
        chance /= chance.sum(2, keepdims=True)
        for j, k in enumerate(some):
            tags = path[j]
            kind = (tags + 1) // 2
            edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (tags[1:] > 0))])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(tags)], strict=True):
                if not kind[a]:
                    continue
                tag = int(kind[a]) * 2
                sure = chance[j, a:b, tag - 1 : tag + 1].sum(1).mean()
                start, end = firsts[k] + a, min(firsts[k] + b, len(texts[owners[k]]))
                if sure >= SURE and end - start >= 6 and TRIGGER.search(texts[owners[k]][start:end]):
                    found[owners[k]].append((KINDS[int(kind[a]) - 1], start, end))
    return found


def find_spans(docs: DataFrame, tagger: Tagger | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``base`` and ``added``: arrays of kind, start and end (code points), by kind and start."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> list:
        texts = batch.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        more = tagged_spans(texts, shared.value) if shared.value else [[] for _ in texts]
        added = []
        for own, new, content in zip(base, more, texts, strict=True):
            taken = gold_tags(len(content), own) if own and new else None
            kept = [s for s in new if taken is None or not taken[s[1] : s[2]].any()]
            added.append(sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1])))
        told = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], span)
        return [batch.column("id"), told(base), told(added)]

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(source, "text", f"id {kind}, base {spans}, added {spans}", work)
