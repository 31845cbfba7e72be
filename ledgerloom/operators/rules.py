"""Category rules: the longest pattern contained in a text wins, ties go to the earlier rule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCATEGORIZED, MISCELLANEOUS, SELF_TRANSFER = "Uncategorized", "Miscellaneous", "Self Transfer"
#: Rules up to this number are matched as one expression; more go through an automaton.
INLINE_RULES = 200

Rule = tuple[str, str]


def longest_match(text: Column, rules: Sequence[Rule], otherwise: str | None = UNCATEGORIZED) -> Column:
    """The category of the longest pattern that the text contains, whatever the case.

    Rules are sorted by length once, so the first hit is the answer: one CASE inside codegen, or beyond
    ``INLINE_RULES`` one Arrow UDF with an automaton.
    """
    kept = [(p.lower(), c) for p, c in rules if p]
    order = sorted(range(len(kept)), key=lambda i: (-len(kept[i][0]), i))
    low = F.lower(F.coalesce(text, F.lit("")))
    if len(order) <= INLINE_RULES:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for i in order:
            out = out.when(low.contains(kept[i][0]), kept[i][1])
        return out.otherwise(F.lit(otherwise))
    ranked = [kept[i] for i in order]

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for rank, (p, _) in enumerate(ranked):
            if p not in found:
                found.add_word(p, rank)
        found.make_automaton()
        for s in batches:
            best = [min((r for _, r in found.iter(t)), default=-1) for t in s]
            yield pd.Series([ranked[r][1] if r >= 0 else otherwise for r in best])

    return F.pandas_udf(match, "string")(low)


def source_kind(source: Column) -> Column:
    return F.when(source.isin("gpay", "paytm", "bhim", "alert") | source.startswith("upi:"), "paymentApp").otherwise("bank")


def source_name(source: Column) -> Column:
    """A source as shown: fixed names, else its slug, short ones in capitals."""
    own = F.element_at(F.split(source, ":"), -1)
    fixed = F.create_map(*(F.lit(x) for pair in {"gpay": "Google Pay", "paytm": "Paytm", "bhim": "BHIM", "hdfc": "HDFC Bank", "idfc": "IDFC First Bank", "alert": "Alerts"}.items() for x in pair))
    shown = F.when(F.length(own) <= 4, F.upper(own)).otherwise(F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, F.lit(2), F.length(own))))
    return F.coalesce(fixed[source], shown)


def effective_category(text: Column, override: Column, source: Column, self_transfer: Column, rules: Sequence[Rule]) -> Column:
    """Self transfer, then the override, then the rules, then a fallback by kind of source."""
    matched = longest_match(text, rules, None)
    fallback = F.when(source_kind(source) == "bank", MISCELLANEOUS).otherwise(UNCATEGORIZED)
    return F.when(self_transfer, SELF_TRANSFER).otherwise(F.coalesce(F.nullif(override, F.lit("")), matched, fallback))


def rule_impact(rows: DataFrame, text: str, rules: Sequence[Rule], new: Rule, fixed: Column, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """Rows whose category a further rule would change; ``fixed`` marks rows that no rule touches."""
    before, after = longest_match(F.col(text), rules), longest_match(F.col(text), [*rules, new])
    return rows.groupBy(*by).agg(F.count_if(~fixed & (before != after)).alias("changed"), F.count("*").alias("rows"))


def seed_rules(stored: DataFrame, seeds: Sequence[Rule]) -> DataFrame:
    """Stored rules plus the seeds that are missing (whatever the case), numbered on. ``stored`` has pattern, category, sort_order."""
    spark = stored.sparkSession
    new = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(seeds)], "pattern string, category string, i int")
    known = stored.select(F.lower("pattern").alias("k")).distinct()
    new = new.withColumn("k", F.lower("pattern")).join(known, "k", "left_anti")
    last = stored.agg(F.coalesce(F.max("sort_order"), F.lit(-1)).alias("last"))
    from pyspark.sql import Window

    # the seeds are a small fixed list, so one window over them is one task by design
    numbered = new.join(F.broadcast(last)).withColumn("sort_order", F.col("last") + F.row_number().over(Window.orderBy("i")))
    return stored.select("pattern", "category", "sort_order").unionByName(numbered.select("pattern", "category", "sort_order"))


def rule_list(rules: DataFrame, categories: Sequence[str] | None = None, query: str = "") -> DataFrame:
    """Rules of some categories whose pattern or category contains a text."""
    out = rules if not categories else rules.where(F.col("category").isin(*categories))
    q = query.lower()
    return out.where(F.lower("pattern").contains(q) | F.lower("category").contains(q)) if q else out
