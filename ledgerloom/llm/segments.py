"""Segment joins over short strings, pairs inside hot groups, and components of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import forget, stored


def allowed_edits(length: Column) -> Column:
    """k for a string of some length: none below four letters, 1 from four, 2 from six, and one more for each twenty letters beyond."""
    return F.when(length < 4, 0).when(length < 6, 1).otherwise(2 + ((length - 6) / 20).cast("int"))


def _cut(df: DataFrame, length: str) -> DataFrame:
    """A row for each of the k + 1 segments of a string of this length: number i, place p, width w."""
    df = df.withColumn("k", allowed_edits(F.col(length)) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    small, long_from = F.expr(f"{length} div k").cast("int"), F.expr(f"k - {length} % k")
    place = F.col("i") * small + F.greatest(F.lit(0), F.col("i") - long_from)
    return df.withColumn("p", place.cast("int")).withColumn("w", (small + (F.col("i") >= long_from).cast("int")).cast("int"))


def segment_join(index: DataFrame, probe: DataFrame, group: list[str], both_ways: bool = True) -> DataFrame:
    """group columns, a, b, d: strings a of ``index`` and b of ``probe`` (column s in both) in one group that differ by 1 to k edits.

    k is that of the shorter string. The shorter of two strings within k edits keeps one of its k + 1 segments unharmed, and k edits can
    shift it by k places at most; so the index of segments is probed at these places and no pair is missed. Candidates are
    verified by banded edit distance. ``both_ways`` also takes index strings that are longer than the probe; a self-join needs it not.
    """
    keys = [F.col(c).alias(f"_g{j}") for j, c in enumerate(group)]
    side = lambda df: df.select(*group, "s").where("s is not null and s <> ''").withColumn("g", F.xxhash64(*group)).withColumn("n", F.length("s"))
    idx, prb = side(index), side(probe)
    pieces = _cut(idx.withColumn("l", F.col("n")), "l").select("g", "l", "i", F.expr("substring(s, p + 1, w)").alias("seg"), *keys, F.col("s").alias("a"))
    k = lambda n: allowed_edits(F.col(n))
    lengths = F.sequence(F.greatest(F.lit(1), F.col("n") - k("n")), F.col("n") + (k("n") + 1 if both_ways else 0))
    hits = prb.withColumn("l", F.explode(lengths)).where(F.abs(F.col("n") - F.col("l")) <= F.when(F.col("l") < F.col("n"), k("l")).otherwise(k("n")))
    hits = _cut(hits, "l")
    low, high = F.greatest(F.lit(0), F.col("p") - F.col("k") + 1), F.least(F.col("n") - F.col("w"), F.col("p") + F.col("k") - 1)
    if not both_ways:
        # the probe is the longer one by d letters: edits before and after the segment share k between them
        d = F.col("n") - F.col("l")
        low = F.greatest(F.lit(0), F.col("p") - ((F.col("k") - 1 - d) / 2).cast("int"))
        high = F.least(F.col("n") - F.col("w"), F.col("p") + ((F.col("k") - 1 + d) / 2).cast("int"))
    hits = hits.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    others = [F.col(c).alias(f"_h{j}") for j, c in enumerate(group)]
    hits = hits.select("g", "l", "i", F.expr("substring(s, at + 1, w)").alias("seg"), *others, F.col("s").alias("b"))
    # both sides are many times what their size is taken for before the explodes, so neither may be broadcast by it
    pairs = pieces.join(hits.hint("merge"), ["g", "l", "i", "seg"]).where(F.col("a") != F.col("b"))
    for j in range(len(group)):
        pairs = pairs.where(F.col(f"_g{j}").eqNullSafe(F.col(f"_h{j}")))
    pairs = pairs.select(*(F.col(f"_g{j}").alias(c) for j, c in enumerate(group)), "a", "b").distinct()
    least = allowed_edits(F.least(F.length("a"), F.length("b")))
    return pairs.withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= least)


def edit_join(keys: DataFrame, group: list[str], key: str = "key", swaps: bool = False) -> DataFrame:
    """group columns, key_a < key_b, d: all pairs of different keys of a group within the allowed edits of the shorter one.

    With ``swaps``, two neighbours in the wrong order are one edit for keys of four and five letters too (from six on k covers them).
    """
    base = keys.select(*group, F.col(key).alias("s")).distinct()
    found = segment_join(base, base, group, both_ways=False).select(*group, F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "d")
    if swaps:
        short = base.where(F.length("s").between(4, 5)).withColumn("_l", F.array_join(F.array_sort(F.split("s", "")), ""))
        a, b = (short.select(*(F.col(c).alias(f"_{p}{j}") for j, c in enumerate(group)), "_l", F.col("s").alias(f"key_{p}")) for p in "ab")
        both = a.join(b, "_l").where("key_a < key_b and levenshtein(key_a, key_b) = 2")
        for j in range(len(group)):
            both = both.where(F.col(f"_a{j}").eqNullSafe(F.col(f"_b{j}")))
        found = found.unionByName(both.select(*(F.col(f"_a{j}").alias(c) for j, c in enumerate(group)), "key_a", "key_b", F.lit(1).alias("d")))
    return found.distinct()


def pairs_within(members: DataFrame, group: list[str], item: str, size: str, keep: list[str] | None = None, salt_rows: int = 2000) -> DataFrame:
    """group columns, a < b, and the columns ``keep`` of a: all pairs of different items of each group.

    ``size`` is a column with the rows of the row's group. A group of more than ``salt_rows`` rows is split: its left
    rows fall to size / salt_rows parts and its right rows go to each part, so no task joins more than salt_rows with the group.
    """
    parts = F.ceil(F.col(size) / F.lit(salt_rows)).cast("int")
    left = members.select(*group, *(keep or []), F.col(item).alias("a"), F.pmod(F.xxhash64(item), parts).cast("int").alias("_part"))
    right = members.select(*group, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return left.join(right, [*group, "_part"]).where("a < b").drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node on an edge (a, b): label is the smallest node of its component.

    Labels fall to the smallest of a node's neighbours and jump along their pointers; each round is written to the shared
    folder, the one before it is removed, and the rounds end when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    step = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("moved", F.lit(True)), "labels")
    while not step.where("moved").isEmpty():
        labels = step.select("node", "label")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("far"))
        fell = lower.join(jump, F.col("next") == F.col("_n"), "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label"))
        former, step = step, stored(fell.select("node", "label", (F.col("old") != F.col("label")).alias("moved")), "labels")
        forget(former)
    forget(both)
    out = step.select("node", "label")
    out.stored_at = step.stored_at
    return out
