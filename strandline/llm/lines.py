"""Removal of repeated runs of lines, by a suffix array over line numbers built with distributed prefix doubling.

All lines get consecutive positions, and each distinct line that occurs twice a rank. A round doubles the lines that
ranks tell apart: the rank at a position is paired with the rank so many lines further, the distinct pairs are sorted
by range over the cluster, and their running counts are the new ranks, so that positions in order of rank
are the suffix array. Suffixes that are alone with their beginning, or end with their document, need no more rounds, and a suffix that ends
sorts before those that go on. Rounds stop when ranks tell MIN_LINES lines apart: more would only put suffixes in
order that have all of those in common.

Common prefixes of neighbours in the array follow from the ranks of every round, largest first. Neighbours with MIN_LINES lines in
common form an interval, and so do those with fewer lines in common that have LONG_WORDS words together. The first suffix of an
interval by identifier and position is the original, and the runs at which the others begin are later copies, and
go. Runs that overlap or touch are one maximal run.

Every step is a DataFrame operation; running sums and neighbours go over range partitions, not over the values of a key, and joins
on a frequent line are split by adaptive execution.

Edge cases: null and empty texts are one empty line; blank lines count like others; words are what blanks and tabs
part; a run that overlaps its own copy goes but for its beginning; repeated rows are copies, and the later one by
position goes; a null identifier sorts first; texts of any length are read whole; an empty table gives an empty table;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.places import placed
from strandline.scratch import stored

MIN_LINES = 3
LONG_WORDS = 50  # that make a run of fewer lines count
ALONE = 1 << 62  # ranks of lines that occur once, above all others


def numbered_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``pos`` (consecutive within a document), ``id``, ``place``, ``line``, ``rest`` (lines to the end), two hashes, and
    ``words`` of the next one, two, ... lines, fewer than ``min_lines``."""
    split = placed(docs).select(F.col(f"`{id_column}`").alias("id"), F.col("_place").alias("place"), F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n").alias("lines"))
    counted = split.withColumn("counts", F.transform("lines", lambda line: F.regexp_count(line, F.lit(r"[^ \t]+"))))
    ahead = lambda i, t: F.aggregate(F.slice("counts", i + 1, t), F.lit(0), lambda total, n: total + n)
    both = F.transform("lines", lambda line, i: F.struct(line.alias("content"), F.array(*(ahead(i, t) for t in range(1, min_lines))).cast("array<int>").alias("words")))
    lines = counted.select("id", "place", F.size("lines").alias("n"), F.posexplode(both).alias("line", "own"))
    return stored(
        lines.select(
            F.monotonically_increasing_id().alias("pos"),
            "id",
            "place",
            "line",
            (F.col("n") - F.col("line")).alias("rest"),
            F.xxhash64("own.content").alias("h1"),
            F.xxhash64(F.lit(1), "own.content").alias("h2"),
            "own.words",
        ),
        "lines",
    )


def ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``classes`` (keys, n) with ``rank``: the sum of ``n`` over all that sort before."""
    dealt = classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "classes")
    before = (Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))  # a row per partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("offset"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy(*keys).rowsBetween(*before))
    return dealt.withColumn("inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(offsets), "part").select(*keys, "n", (F.col("offset") + F.col("inner")).alias("rank"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """``pos``, ``rest``, ``rank``, ``done`` of the lines that occur more than once."""
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lines.select("pos", "rest", "h1", "h2").join(ranked(classes, ["h1", "h2"]), ["h1", "h2"])
    return stored(found.select("pos", "rest", "rank", (F.col("rest") <= 1).alias("done")), "ranks")


def doubled(ranks: DataFrame, covered: int) -> DataFrame:
    """Ranks by twice as many lines as the ``covered`` ones."""
    further = ranks.select((F.col("pos") - covered).alias("pos"), F.col("rank").alias("further"))
    second = F.when(F.col("rest") <= covered, -1).otherwise(F.coalesce("further", ALONE + F.col("pos") + covered))
    pairs = ranks.filter(~F.col("done")).join(further, "pos", "left").select("pos", "rest", "rank", second.alias("second"), "done")
    pairs = stored(pairs.union(ranks.filter("done").select("pos", "rest", "rank", F.lit(-1).cast("long"), "done")), "pairs")
    classes = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n"))
    keyed = ranked(classes.select(F.col("rank").alias("own"), "second", "n"), ["own", "second"])
    found = pairs.join(keyed.select(F.col("own").alias("rank"), "second", "n", F.col("rank").alias("now")), ["rank", "second"])
    done = F.col("done") | (F.col("n") == 1) | (F.col("rest") <= 2 * covered)
    return stored(found.select("pos", "rest", F.col("now").alias("rank"), done.alias("done")), "ranks")


def suffix_ranks(lines: DataFrame, depth: int | None = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """For 1, 2, 4, ... lines, ``pos``, ``rest`` and the ``rank`` among suffixes by so many lines; the last are the array's.

    With ``depth`` None suffixes are told apart to their ends.
    """
    levels = [(1, first_ranks(lines))]
    while (depth is None or levels[-1][0] < depth) and not levels[-1][1].filter(~F.col("done")).isEmpty():
        covered, ranks = levels[-1]
        levels.append((covered * 2, doubled(ranks, covered)))
    return levels


def common_prefixes(levels: list[tuple[int, DataFrame]], most: int) -> DataFrame:
    """The classes of equal suffixes in order: ``part``, ``rank``, and the lines, at most about ``most``, in ``common`` with the class before."""
    classes = levels[-1][1].groupBy("rank").agg(F.min(F.struct("pos", "rest")).alias("here"))
    dealt = stored(classes.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id()), "classes")
    inner = F.lag("here").over(Window.partitionBy("part").orderBy("rank"))
    ends = dealt.groupBy("part").agg(F.max_by("here", "rank").alias("last"))  # a row per partition
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    pairs = dealt.withColumn("inner", inner).join(F.broadcast(ends), "part").withColumn("before", F.coalesce("inner", "last"))
    pairs = pairs.select("part", "rank", F.col("here.pos").alias("p"), F.col("before.pos").alias("q"), F.least("here.rest", "before.rest").alias("rest"), F.lit(0).alias("common"))
    for covered, ranks in reversed([x for x in levels if x[0] <= most]):
        mine = ranks.select((F.col("pos")).alias("p_at"), F.col("rank").alias("p_rank"))
        theirs = ranks.select((F.col("pos")).alias("q_at"), F.col("rank").alias("q_rank"))
        found = pairs.join(mine, F.col("p") + F.col("common") == F.col("p_at"), "left").join(theirs, F.col("q") + F.col("common") == F.col("q_at"), "left")
        # Behind its end a suffix has nothing in common with another, whatever stands there.
        same = (F.col("p_rank") == F.col("q_rank")) & (F.col("common") < F.col("rest"))
        more = F.when(same, F.least(F.lit(covered), F.col("rest") - F.col("common"))).otherwise(0)
        pairs = stored(found.withColumn("common", F.col("common") + more).select("part", "rank", "p", "q", "rest", "common"), "common")
    return pairs.select("part", "rank", "common")


def intervals(prefixes: DataFrame, most: int) -> DataFrame:
    """``rank`` and ``intervals``: for 1, 2, ... ``most`` lines, the number of the interval with so many in common."""
    names = [f"b{t}" for t in range(1, most + 1)]
    begins = prefixes.select("part", "rank", *((F.col("common") < t).cast("long").alias(n) for t, n in enumerate(names, 1)))
    totals = begins.groupBy("part").agg(*(F.sum(n).alias(f"total_{n}") for n in names))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *(F.coalesce(F.sum(f"total_{n}").over(before), F.lit(0)).alias(f"offset_{n}") for n in names))
    inner = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = begins.select("part", "rank", *(F.sum(n).over(inner).alias(n) for n in names)).join(F.broadcast(offsets), "part")
    return summed.select("rank", F.array(*(F.col(n) + F.col(f"offset_{n}") for n in names)).alias("intervals"))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``pos`` and ``n`` of runs of ``n`` lines that an earlier place has too, of ``min_lines`` lines or ``long_words`` words."""
    levels = suffix_ranks(lines, min_lines)
    held = levels[-1][1].select("pos", "rest", "rank").join(intervals(common_prefixes(levels, min_lines), min_lines), "rank")
    counted = held.join(lines.select("pos", "id", "words"), "pos")
    long_ = lambda t: (F.col("rest") >= t) & (F.get("words", F.lit(t - 1)) >= long_words) if t < min_lines else F.col("rest") >= t
    runs = F.array_compact(F.array(*(F.when(long_(t), F.struct(F.lit(t).alias("n"), F.get("intervals", F.lit(t - 1)).alias("interval"))) for t in range(1, min_lines + 1))))
    runs = stored(counted.select("pos", "id", F.explode(runs).alias("run")).select("pos", "id", "run.*"), "runs")
    first = runs.groupBy("n", "interval").agg(F.min(F.struct("id", "pos")).alias("original"), F.count(F.lit(1)).alias("size"))
    return runs.join(first.filter("size > 1"), ["n", "interval"]).filter("pos != original.pos").select("pos", "n")


def repeated_line_runs(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS
) -> DataFrame:
    """``place``, ``first``, ``last``: maximal runs of lines of each document that are later copies."""
    lines = numbered_lines(docs, min_lines, id_column, text)
    copies = later_copies(lines, min_lines, long_words)
    gone = copies.select(F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    placed_ = gone.join(lines.select("pos", "place", "line"), "pos")
    order = Window.partitionBy("place").orderBy("line")
    islands = placed_.withColumn("island", F.col("line") - F.row_number().over(order))
    return islands.groupBy("place", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def remove_repeated_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS
) -> DataFrame:
    """``id``, ``place``, ``n_lines``, ``runs`` (removed, first and last line) and ``kept`` (text) of every document."""
    runs = repeated_line_runs(docs, min_lines, id_column, text, long_words)
    mine = runs.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    rows = placed(docs).select(F.col(f"`{id_column}`").alias("id"), F.col("_place").alias("place"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return rows.join(mine, "place", "left").select(
        "id",
        "place",
        F.size(lines).alias("n_lines"),
        F.coalesce("runs", none).alias("runs"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept"),
    )
