"""Near-duplicate documents by SimHash and the Jaccard similarity of their word shingles, all pairs at or above a threshold.

Every text gets its SimHash fingerprint, and fingerprints at most 4 bits apart are linked as ``simhash`` does; the sets
of the texts so met are compared whole. Fingerprints miss most pairs close to the threshold, so sets also meet by their shingles:
two sets that share at least 0.8 of their union have, in whatever order all shingles are sorted, one in common among
the first n - ceil(0.8 n) + 1 of the larger (n its size) and the first n - ceil(8/9 n) + 1 of the smaller: together
they have at least 8/9 of the smaller's. Only these are shuffled, and sets that meet so are compared
whole. Texts that share a template and are no copies of each other do not meet, as their own shingles come first and are more than the
smaller set's ninth. The order puts shingles that are frequent in a sample last, so that common passages do not make sets meet; the
sample changes what it costs, not what is found.

Of first shingles that the same sets have, one is kept: the others make the same pairs.
Sets that share a first shingle are never all paired while most of them are copies of each other: in rounds, each set is compared with one
member of the component that most sets of the shingle are in, another one each round, and what is found joins the
components. Only the sets that are in different components after that are paired. Every set has 512 bits, the parities of its shingles
in as many classes: two sets have at least as many shingles apart as bits, so pairs with too many are left before they are rows. So are
pairs at a shingle if the sets share one of the eight before it as well, where they are paired already.
Before texts are read again, pairs whose sizes and first shingles rule the similarity out are left too.

Sets are told apart and named by 128-bit hashes of 64-bit hashes of the shingles, and so are the groups of sets that have a shingle.

Edge cases: null and empty texts, and texts of white space alone, have the empty set and are copies of each other;
texts with fewer words than a shingle are one shingle; a null identifier sorts first; texts of any length are read
whole; an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.frames import map_arrow, map_texts
from strandline.llm.places import PLACE, placed, without
from strandline.llm.simhash import fingerprint_of, near_pairs, shingle_hashes
from strandline.llm.tables import bits_for, frequent, holds
from strandline.scratch import stored

WORDS = 5
# Cost only: documents among which frequent shingles are looked for, and how many of those are told to all tasks.
SAMPLE = 20_000
FREQUENT = 500_000
# Cost only: rounds go on while more pairs than so many for each row are left of keys that lost a quarter of theirs in the last one.
PAIRS_PER_ROW = 8
# Cost only: shingles of a set before another one that are looked at for an earlier meeting of the same two sets.
EARLIER = 8
LONGS = 8  # of a set's parities
PARITIES = f"struct<{', '.join(f'b{i}:bigint' for i in range(LONGS))}>"


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending."""
    return np.unique(shingle_hashes(data, words))


def prefix_size(size: int) -> int:
    """How many of a set's first shingles hold one of every set with a Jaccard similarity of 0.8 or more."""
    return size - (4 * size + 4) // 5 + 1 if size else 0


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * LONGS classes of hashes, whether an odd number of the shingles is in it, as bits of longs."""
    odd = np.bincount((shingles % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(u: str, v: str) -> str:
    """At least so many shingles are in only one of two sets, by their parities."""
    return " + ".join(f"bit_count({u}.b{i} ^ {v}.b{i})" for i in range(LONGS))


def _may_be_near(n_u: str, n_v: str, bits_u: str, bits_v: str) -> str:
    """Whether sizes and parities leave a Jaccard similarity of 0.8 or more: at most a ninth of the shingles apart."""
    return f"5 * {n_u} >= 4 * {n_v} AND 5 * {n_v} >= 4 * {n_u} AND 9 * ({_apart(bits_u, bits_v)}) <= {n_u} + {n_v}"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def _frequent(named: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents of a sample have, ascending, and in how many they are."""
    share = min(1.0, sample / max(1, named.count()))
    some = named.filter(F.pmod(F.xxhash64("who.place"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = map_texts(some, "data", "shingles array<bigint>", lambda batch: [_lists([shingle_set(d, words) for d in batch.column("data").to_pylist()])])
    counted = found.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    most = counted.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    names, counts = most["shingle"].to_numpy().view(np.uint64), most["n"].to_numpy()
    order = np.argsort(names)
    return names[order], counts[order]


def _verified(pairs: DataFrame, nodes: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """The ``pairs`` (u, v) whose sets have a Jaccard similarity of 0.8 or more. Only their texts are read again."""
    pairs = stored(pairs, "pairs")
    chosen = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    places = nodes.join(chosen, "node").select("node", "first.place")
    wanted = places.select(F.xxhash64("place").alias("at"))
    texts = _likely(named.select("who.place", "data", F.xxhash64("who.place").alias("at")), wanted).join(places, "place").select("node", "data")
    made = map_texts(texts, "data", "node binary, shingles array<bigint>", lambda batch: [batch.column("node"), _lists([shingle_set(d, words) for d in batch.column("data").to_pylist()])])
    sets = stored(made, "shingles")
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("mine"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("theirs"))
    both = F.size(F.array_intersect("mine", "theirs"))
    near = both * 9 >= (F.size("mine") + F.size("theirs")) * 4  # both / (mine + theirs - both) >= 0.8
    return stored(pairs.join(left, "u").join(right, "v").filter(near).select("u", "v"), "verified")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hash ``at`` is not ``wanted``: a table of bounded size tells them before the shuffle."""
    wanted = stored(wanted, "wanted")
    kept = [c for c in rows.columns if c != "at"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column("at").to_numpy(zero_copy_only=False).view(np.uint64)

    shared = rows.sparkSession.sparkContext.broadcast(frequent(wanted, hashes, 1, bits_for(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = holds(shared.value, batch.column("at").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select(kept).filter(pa.array(there))

    return map_arrow(rows, run, ", ".join(f"{c} {t}" for c, t in rows.select(kept).dtypes))


def _entries(rows: DataFrame) -> DataFrame:
    """``node``, ``n``, ``key`` and ``short``: the first shingles of each set, those that another row may have too."""
    # Most shingles are in one text only. A table of bounded size tells them before anything is shuffled.
    keys = rows.select("keys")
    # Of equally frequent shingles the least are first, and tables go by leading bits: a product fills all of the table.
    spread = lambda flat: flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield spread(pc.list_flatten(batch.column("keys")).to_numpy(zero_copy_only=False))

    count = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = rows.sparkSession.sparkContext.broadcast(frequent(keys, hashes, 2, bits_for(count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("keys")
            flat = pc.list_flatten(own).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(own).to_numpy(zero_copy_only=False)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            size = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            short = np.arange(len(flat)) - first[row] < size - (8 * size + 8) // 9 + 1
            kept = np.flatnonzero(holds(shared.value, spread(flat)))
            pick = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pick), batch.column("n").take(pick), pa.array(flat[kept]), pa.array(short[kept])], ["node", "n", "key", "short"]
            )

    return map_arrow(rows.select("node", "n", "keys"), run, "node binary, n int, key bigint, short boolean").distinct()


def _telling(entries: DataFrame) -> DataFrame:
    """``key``: of all keys that the same sets have, alike in which are short, the least one; none that makes no pair."""
    # A key without a smaller set's first shingle makes no pair.
    group = [F.bit_xor(F.xxhash64("node", "short", F.lit(seed))).alias(f"group{seed}") for seed in (0, 1)]
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or("short").alias("some"), *group).filter("size > 1 AND some")
    return several.groupBy("size", "group0", "group1").agg(F.min("key").alias("key")).select("key")


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v) by SimHash: a node and the least one of its fingerprint, and the least ones of linked fingerprints."""
    prints = stored(rows.select("fp", "node").distinct(), "prints")
    least = stored(prints.groupBy("fp").agg(F.min("node").alias("least")), "prints-least")
    same = prints.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v"))
    mine = least.select(F.col("fp").alias("u"), F.col("least").alias("a"))
    theirs = least.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    linked = near_pairs(least.select("fp")).distinct().join(mine, "u").join(theirs, "v")
    return same.union(linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).filter("u != v")


def _possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) that may have a Jaccard similarity of 0.8 or more by their sizes and first shingles, without their texts.

    Of two sets, one has all its shingles up to the lesser of their two last first shingles among its first ones. Common
    shingles up to there are among the first of both, and no more follow than that set has others.
    """
    pairs = stored(pairs, "candidates")
    chosen = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().select(F.xxhash64("node").alias("at"))
    sets = _likely(rows.select("node", "n", "keys", F.xxhash64("node").alias("at")), chosen).dropDuplicates(["node"])
    sets = stored(sets.select("node", "n", "keys"), "first-shingles")
    mine, theirs = (sets.select(F.col("node").alias(name), F.struct("n", "keys").alias(f"of_{name}")) for name in "uv")
    alike = "5 * of_u.n >= 4 * of_v.n AND 5 * of_v.n >= 4 * of_u.n"
    most = "size(array_intersect(of_u.keys, of_v.keys)) + greatest(of_u.n - size(of_u.keys), of_v.n - size(of_v.keys))"
    return pairs.join(mine, "u").join(theirs, "v").filter(f"{alike} AND 9 * ({most}) >= 4 * (of_u.n + of_v.n)").select("u", "v")


def _told(met: DataFrame, labels: DataFrame | None, at: int) -> tuple[DataFrame, DataFrame]:
    """``met`` with each set's component as ``label``; of each key in more than one, its most frequent label as ``main`` and one of
    those sets as ``pick``, another one for each ``at``, and as ``apart`` how many pairs of its sets are in different components."""
    label = F.col("node").alias("label")
    if labels is not None:
        met, label = met.join(labels, "node", "left"), F.coalesce("component", "node").alias("label")
    told = stored(met.select("key", "node", "n", "short", "bits", label), "told")
    pick = F.min_by(F.struct("node", "n", "short", "bits"), F.xxhash64("node", F.lit(at))).alias("pick")
    by_label = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), pick)
    most = F.max_by(F.struct("label", "pick"), F.struct("size", "label")).alias("most")
    mains = by_label.groupBy("key").agg(most, F.count(F.lit(1)).alias("labels"), F.expr("(sum(size) * sum(size) - sum(size * size)) DIV 2").alias("apart"))
    return told, stored(mains.filter("labels > 1").select("key", F.col("most.label").alias("main"), "most.pick", "apart"), "mains")


def _unlinked(told: DataFrame, mains: DataFrame) -> DataFrame:
    """Of every key, all pairs (u, v) that are not in one component yet and may be near: those not of its most frequent one, with all others.

    A pair that shares several keys may be there more than once."""
    # Two sets are paired at the first key, in the order of keys, that both have and the smaller has as a short one; not at a later one
    # of which that can be told.
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
    told = told.withColumns({"earlier": F.collect_list("key").over(before), "earlier_short": F.collect_list(F.when(F.col("short"), F.col("key"))).over(before)})
    mixed = told.join(mains.select("key", "main"), "key").withColumn("in_main", F.col("label") == F.col("main"))
    smaller = mixed.filter("short").select("key", *(F.col(c).alias(f"{c}_u") for c in ("node", "n", "bits", "label", "earlier_short")), "in_main")
    larger = mixed.select("key", *(F.col(c).alias(f"{c}_v") for c in ("node", "n", "bits", "label", "earlier")), F.col("in_main").alias("v_in_main"))
    near = f"label_u != label_v AND n_u <= n_v AND {_may_be_near('n_u', 'n_v', 'bits_u', 'bits_v')} AND NOT arrays_overlap(earlier_short_u, earlier_v)"
    pairs = smaller.filter("NOT in_main").join(larger, "key").drop("in_main", "v_in_main").unionByName(
        smaller.filter("in_main").join(larger.filter("NOT v_in_main"), "key").drop("in_main", "v_in_main")
    )
    return pairs.filter(near).select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v"))


def _linked(sure: DataFrame, met: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges whose components are those of ``sure`` and of all pairs that share a key and are ``verified``."""
    told, mains = _told(met, None, 0)
    most, at = PAIRS_PER_ROW * met.count(), 0
    while True:
        tied = told.join(mains, "key").filter(
            f"label != main AND ((short AND n <= pick.n) OR (pick.short AND pick.n <= n)) AND {_may_be_near('n', 'pick.n', 'bits', 'pick.bits')}"
        )
        tied = tied.select(F.greatest("node", "pick.node").alias("u"), F.least("node", "pick.node").alias("v"))
        found = verified(tied.union(sure).distinct() if at == 0 else tied.distinct())
        labels = stored(connected_components(found if at == 0 else sure.union(found)), "labels")
        sure, at, before = labels.select(F.col("node").alias("u"), F.col("component").alias("v")), at + 1, mains.select("key", F.col("apart").alias("was"))
        told, mains = _told(met, labels, at)
        # Keys whose sets are mostly no copies stay as they are, and call for no further round.
        if (mains.join(before, "key").filter("4 * apart <= 3 * was").agg(F.sum("apart")).first()[0] or 0) <= most:
            break
    return sure.union(verified(_unlinked(told, mains).distinct()))


def near_copies(named: DataFrame, words: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """``who`` and ``least`` (the least ``who`` of its component) of every row; ``named``: who (id, place), data (binary)."""
    shared = named.sparkSession.sparkContext.broadcast(_frequent(named, words, sample))

    def work(batch: pa.RecordBatch) -> list:
        names, counts = shared.value
        nodes, sizes, prints, odd, firsts = [], [], [], [], []
        for data in batch.column("data").to_pylist():
            every = shingle_hashes(data, words)
            own = np.unique(every)
            often = np.zeros(len(own), np.int64)
            if len(names):
                place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                often = np.where(names[place] == own, counts[place], 0)
            nodes.append(xxhash.xxh128_digest(own.tobytes()))
            sizes.append(len(own))
            prints.append(fingerprint_of(every))
            odd.append(parities(own))
            firsts.append(own[np.lexsort((own, often))[: prefix_size(len(own))]])
        bits = pa.StructArray.from_arrays([pa.array(b) for b in np.array(odd).T], [f"b{i}" for i in range(LONGS)])
        return [batch.column("who"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), bits, _lists(firsts)]

    rows = stored(map_texts(named, "data", f"who {named.schema['who'].dataType.simpleString()}, node binary, n int, fp bigint, bits {PARITIES}, keys array<bigint>", work), "sets")
    nodes = stored(rows.groupBy("node").agg(F.min("who").alias("first"), F.any_value("bits").alias("bits")), "nodes")
    entries = stored(_entries(rows), "entries")
    met = stored(entries.join(_telling(entries), "key").join(nodes.select("node", "bits"), "node"), "met")
    edges = _linked(_by_fingerprint(rows), met, lambda pairs: _verified(_possible(pairs, rows), nodes, named, words))
    groups = stored(connected_components(edges), "groups")
    grouped = nodes.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    leasts = grouped.groupBy("component").agg(F.min("first").alias("least"))
    return rows.select("who", "node").join(grouped.join(leasts, "component").select("node", "least"), "node").select("who", "least")


def drop_near_copies(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, read from files, with one document of each component: the least identifier, first by place."""
    who = F.struct(F.col(f"`{id_column}`").alias("id"), F.col("_place").cast(PLACE).alias("place")).alias("who")
    named = placed(docs).select(who, F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    return without(docs, near_copies(named, words).filter("who != least").select("who.place"))
