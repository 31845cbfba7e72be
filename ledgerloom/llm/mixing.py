"""Mixing sources to target weights: certain copies, then Pareto order sampling.

A source's goal is its share of all tokens, or all it may give. Each document is due copies in proportion to its weight (its tokens to the power
``SIZE_POWER``, or a column of the caller's, such as a quality), as many that the source's tokens come to the goal, and ``max_repeats`` at most; what the capped
documents can't take is shared by the others. The whole part of what a document is due is given for certain; the fraction is its inclusion
odds of one more copy. Documents of a source are ranked by their random odds over their inclusion odds, u / (1 - u) : pi / (1 - pi), and the first ones are
taken until the fixed size, the tokens still missing, is reached: a sample of fixed size and unequal probabilities.

Weights are taken in steps of one percent, so what documents are due is solved over a few thousand sums by (source, weight step) and not over documents.
No source is sorted: token sums by (source, band of the rank) tell the band in which the goal is reached, that band is cut into finer ones as
long as it holds more than ``EDGE_ROWS`` documents, and the rest is ranked. A source may so hold any part of all rows.

Defined cases: null texts count no token and are not drawn; a text without tokens is not drawn; a source without target is not drawn and its
tokens still count for the total; a target without documents reaches 0; a null or negative share counts as 0, a null cap as 1; a null or
non-positive weight counts as the least weight; repeated rows are documents of their own; the random number comes from a hash of seed, id and text, so
a rerun draws the same mix.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BANDS = 4096
#: Documents of one source that are ranked in one task.
EDGE_ROWS = 100_000
SIZE_POWER = 0.5
#: Longest text given to the tokenizer at once. Longer ones are cut where a word begins after a space, which is always a bound of tokens; never elsewhere.
PIECE = 100_000
_CUT = re.compile(r"(?<=\S) (?=[^\W_])")


def token_counts(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_tokens. The vocabulary is read once in each Python worker from ``path``."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def one(t: str | None) -> int:
            n, at = 0, 0
            while t and at < len(t):
                cut = _CUT.search(t, at + PIECE) if len(t) - at > PIECE else None
                to = cut.start() if cut else len(t)
                n += len(enc.encode_ordinary(t[at:to]))
                at = to
            return n

        for texts in batches:
            yield texts.map(one, na_action=None).astype("int64")

    return docs.withColumn("n_tokens", F.pandas_udf(count, "bigint")(F.coalesce(F.col(text), F.lit(""))))


def _due(classes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, step, due: copies that a document of each weight step is due.

    With the j heaviest steps at the cap, the others are due c times their weight, where c makes the tokens come to the goal. The right j is the least
    for which none of the others exceeds the cap.
    """
    k = classes.join(goals, "source").withColumn("w", F.pow(F.lit(1.01), F.col("step")))
    down = Window.partitionBy("source").orderBy(F.col("step").desc())
    k = k.withColumn("above", F.sum("tokens").over(down) - F.col("tokens")).withColumn("heavy", F.sum(F.col("w") * F.col("tokens")).over(Window.partitionBy("source").orderBy("step")))
    c = (F.col("goal") - F.col("cap") * F.col("above")) / F.col("heavy")
    k = k.withColumn("c", F.when(c * F.col("w") <= F.col("cap"), c))
    first = k.groupBy("source").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("step"))).alias("c"), F.max(F.when(F.col("c").isNotNull(), F.col("step"))).alias("from"))
    k = k.drop("c").join(first, "source")
    due = F.when(F.col("step") <= F.col("from"), F.col("c") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return k.select("source", "step", F.greatest(F.lit(0.0), F.least(due, F.col("cap").cast("double"))).alias("due"))


def draw(sized: DataFrame, targets: DataFrame, row_id: str = "doc_id", weight: str | None = None, edge_rows: int = EDGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mix (row_id, source, n_tokens, copies) and the report of each source; ``sized`` has n_tokens and u in (0, 1), and ``weight`` if named."""
    heavy = F.pow(F.col("n_tokens").cast("double"), F.lit(SIZE_POWER)) if weight is None else F.col(weight).cast("double")
    # weights outside 1e-9 .. 1e9 count as these
    step = F.round(F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1e9), F.coalesce(heavy, F.lit(0.0))))) / F.log(F.lit(1.01))).cast("int")
    docs = sized.where("n_tokens > 0").select(row_id, "source", "n_tokens", "u", step.alias("step"))
    classes = stored(docs.groupBy("source", "step").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "weight-steps")
    have = classes.groupBy("source").agg(F.sum("tokens").alias("have"))
    counts = sized.groupBy("source").agg(F.count("*").alias("n_docs"))
    total = float(classes.agg(F.sum("tokens")).first()[0] or 0)
    want = targets.groupBy("source").agg(F.greatest(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("cap"))
    plan = stored(want.join(have, "source", "left").join(counts, "source", "left").na.fill(0, ["have", "n_docs", "share"]).withColumn("goal", F.least(F.col("share") * F.lit(total), F.col("have") * F.col("cap"))), "mix-plan")
    due = _due(classes, plan.where("have > 0").select("source", "goal", "cap")).withColumn("certain", F.floor(F.col("due") + 1e-9).cast("int")).withColumn("pi", F.greatest(F.lit(0.0), F.col("due") - F.col("certain")))
    due = stored(due.withColumn("pi", F.when(F.col("pi") > 1e-9, F.col("pi")).otherwise(0.0)), "mix-due")

    given = due.join(classes, ["source", "step"]).groupBy("source").agg(F.sum(F.col("certain") * F.col("tokens")).alias("sure"))
    missing = plan.join(given, "source").select("source", (F.col("goal") - F.col("sure")).alias("missing"))
    docs = docs.join(due.select("source", "step", "certain", "pi"), ["source", "step"])
    # the Pareto rank r as r / (1 + r), which lies in (0, 1) and has the same order
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("pi")) / F.col("pi")
    docs = docs.withColumn("rank", F.when(F.col("pi") > 0, odds / (1 + odds))).withColumn("place", F.floor(F.col("rank") * F.lit(float(2**60))).cast("bigint"))
    docs = stored(docs.select(row_id, "source", "n_tokens", "u", "certain", "rank", "place"), "ranked")

    # the span of ranks in which a source reaches its size, cut into bands again until few documents are in it
    edge = missing.where("missing > 0").select("source", "missing", F.lit(0).cast("bigint").alias("low"), F.lit(0.0).alias("before"))
    for level in range(1, 6):
        width = 2**60 // BANDS**level
        inside = docs.where("place is not null").join(edge, "source").where(F.col("place").between(F.col("low"), F.col("low") + (width * BANDS - 1)))
        band = F.shiftright(F.col("place") - F.col("low"), width.bit_length() - 1)
        sums = inside.groupBy("source", "missing", "low", "before", band.alias("band")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        sums = sums.withColumn("start", F.col("before") + F.sum("t").over(Window.partitionBy("source").orderBy("band")) - F.col("t"))
        last = sums.where("start < missing").groupBy("source").agg(F.max_by(F.struct("missing", "low", "band", "start", "n"), "band").alias("e")).select("source", "e.*")
        edge = stored(last.select("source", "missing", (F.col("low") + F.col("band") * F.lit(width)).cast("bigint").alias("low"), F.col("start").alias("before"), "n"), "mix-edge")
        if (edge.agg(F.max("n")).first()[0] or 0) <= edge_rows:
            break
    docs = docs.join(edge.select("source", "missing", "low", "before"), "source", "left")
    within = F.coalesce(F.col("place").between(F.col("low"), F.col("low") + (width - 1)), F.lit(False))
    inner = docs.where(within)
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", F.col(row_id), "u").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the document that crosses the goal is taken if that comes nearer to it
    inner = inner.withColumn("more", (F.col("before") + run - F.col("n_tokens") / 2 <= F.col("missing")).cast("int"))
    outer = docs.where(~within).withColumn("more", F.coalesce((F.col("place") < F.col("low")).cast("int"), F.lit(0)))
    mix = outer.unionByName(inner).withColumn("copies", F.col("certain") + F.col("more")).where("copies > 0").select(row_id, "source", "n_tokens", "copies")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    report = stored(plan.select("source", "share", "cap", "have", "n_docs").join(got, "source", "left").na.fill(0, ["got", "n_copies", "most_copies"]), "mix-report")
    mixed = float(report.agg(F.sum("got")).first()[0] or 0)
    ratio = lambda a, b: (F.col(a) / F.lit(b)) if b > 0 else F.lit(0.0)
    report = report.select("source", F.col("share").alias("target_share"), F.col("cap").cast("int").alias("max_repeats"), "n_docs", F.col("have").alias("source_tokens"), F.col("got").alias("mix_tokens"), "n_copies", "most_copies", ratio("got", total).alias("share_of_text"), ratio("got", mixed).alias("share_of_mix"))
    return mix, report


def sized_documents(docs: DataFrame, row_id: str = "doc_id", path: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """row_id, source, n_tokens, u: tokens counted once and kept, since the mix reads them several times."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(row_id), F.col("text")), F.lit(2**52)) + 0.5) / float(2**52)
    return stored(token_counts(docs.where("text is not null").select(row_id, "source", "text").withColumn("u", u), path=path).select(row_id, "source", "n_tokens", "u"), "sized")


def mix_sources(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    return draw(sized_documents(docs, path=path, seed=seed), targets)
