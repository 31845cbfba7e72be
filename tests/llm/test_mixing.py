import base64
import math

from pyspark.sql import functions as F

from ledgerloom.llm import mixing

SIZED = "doc_id long, source string, n_tokens long, u double"


def _plain_count(text):
    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return len(tiktoken.Encoding("bpe", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))


def sized(spark, sizes):
    import random

    rng = random.Random(1)
    rows = [(i, s, rng.randint(5, 15), rng.random()) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, SIZED)


def test_shares_caps_and_reports(spark):
    docs = sized(spark, {"big": 4000, "mid": 600, "small": 50, "unused": 100})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.05, 3), ("absent", 0.15, 4), (None, 0.0, None)], "source string, target_share double, max_repeats int")
    mix, report = mixing.draw(docs, targets)
    r = {x.source: x for x in report.collect()}
    total = docs.groupBy().sum("n_tokens").first()[0]
    assert abs(r["big"].mix_tokens - 0.5 * total) <= 15 and r["big"].most_copies == 1
    # mid has too little for its share: every copy it may give
    assert r["mid"].mix_tokens == 2 * r["mid"].source_tokens and r["mid"].n_copies == 1200
    assert r["small"].most_copies <= 3 and r["absent"].mix_tokens == 0 and r["absent"].n_docs == 0
    assert abs(sum(x.share_of_mix for x in r.values()) - 1) < 1e-9
    got = mix.collect()
    assert len({x.doc_id for x in got}) == len(got) and {x.source for x in got} == {"big", "mid", "small"}
    assert sorted(map(tuple, mixing.draw(docs.repartition(7), targets)[0].collect())) == sorted(map(tuple, got))


def test_whole_and_fractional_copies(spark):
    docs = sized(spark, {"a": 1000, "b": 3000})
    mix, report = mixing.draw(docs, spark.createDataFrame([("a", 0.6, 9)], "source string, target_share double, max_repeats int"))
    copies = {x.copies for x in mix.collect()}
    assert copies <= {1, 2, 3, 4} and mix.count() == 1000  # about 2.4 copies of each, more of the longer ones
    total = docs.groupBy().sum("n_tokens").first()[0]
    assert abs(report.first().mix_tokens - 0.6 * total) <= 15


def test_what_documents_are_due_against_a_plain_solution(spark):
    """Weights over six powers of ten, so that heavy documents reach the cap: what is due comes to the goal, in proportion below the cap."""
    import random

    rng = random.Random(4)
    weights = {i: 10 ** rng.uniform(-3, 3) for i in range(300)}
    steps = {i: round(math.log(w) / math.log(1.01)) for i, w in weights.items()}
    goal, cap = 4000, 3
    classes = spark.createDataFrame([("s", s, 10) for s in steps.values()], "source string, step int, tokens long").groupBy("source", "step").agg(F.sum("tokens").alias("tokens"))
    due = {r.step: r.due for r in mixing._due(classes, spark.createDataFrame([("s", float(goal), cap)], "source string, goal double, cap int")).collect()}
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(10 * min(cap, c * 1.01**s) for s in steps.values()) < goal else (low, c)
    assert all(abs(due[s] - min(cap, c * 1.01**s)) < 1e-6 for s in steps.values()) and abs(sum(10 * due[s] for s in steps.values()) - goal) < 1e-6
    assert any(d == cap for d in due.values()) and any(d < 0.01 for d in due.values())


def test_unequal_odds_are_followed(spark):
    """Documents of a quality of 1, 2 and 4 are drawn in these proportions, and the size is the same in each draw."""
    import random

    rows = [(seed * 1000 + i, f"s{seed}", 10, random.Random(seed * 1000 + i).random(), float(4 ** (i % 3) ** 0.5 if i % 3 < 2 else 4)) for seed in range(40) for i in range(90)]
    rows = [(a, b, n, u, (1.0, 2.0, 4.0)[a % 1000 % 3]) for a, b, n, u, _ in rows]
    docs = spark.createDataFrame(rows, SIZED + ", quality double")
    targets = spark.createDataFrame([(f"s{k}", 0.2 / 40, 1) for k in range(40)], "source string, target_share double, max_repeats int")
    mix, report = mixing.draw(docs, targets, weight="quality")
    kinds = [0, 0, 0]
    for r in mix.collect():
        kinds[r.doc_id % 1000 % 3] += 1
    assert {r.n_copies for r in report.collect()} == {18} and sum(kinds) == 40 * 18
    unit = sum(kinds) / 7
    assert abs(kinds[0] - unit) < 30 and abs(kinds[1] - 2 * unit) < 45 and abs(kinds[2] - 4 * unit) < 45


def test_finer_bands_give_the_same_mix(spark):
    docs = sized(spark, {"big": 3000, "small": 40})
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.02, 2)], "source string, target_share double, max_repeats int")
    once = sorted(map(tuple, mixing.draw(docs, targets)[0].collect()))
    assert once == sorted(map(tuple, mixing.draw(docs, targets, edge_rows=0)[0].collect())) and once
    twins = docs.union(docs).union(docs)  # equal ranks can't be told apart by bands
    assert abs(mixing.draw(twins, targets, edge_rows=1)[1].where("source = 'big'").first().mix_tokens - 0.3 * 3 * docs.groupBy().sum("n_tokens").first()[0]) <= 15


def test_equal_documents_have_equal_odds(spark):
    """Twenty sources of forty equal documents, 12 of which are drawn from each."""
    import random

    rng = random.Random(9)
    docs = spark.createDataFrame([(s * 100 + i, f"s{s}", 10, rng.random()) for s in range(20) for i in range(40)], SIZED)
    targets = spark.createDataFrame([(f"s{s}", 0.3 / 20, 1) for s in range(20)], "source string, target_share double, max_repeats int")
    hits = [0] * 40
    for x in mixing.draw(docs, targets)[0].collect():
        hits[x.doc_id % 100] += 1
    assert sum(hits) == 20 * 12 and max(hits) < 15


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "s", "Hello world"), (2, "s", None), (3, None, ""), (4, "s", "word " * 60_000)], "doc_id long, source string, text string")
    n = {r.doc_id: r.n_tokens for r in mixing.token_counts(df).collect()}
    long = "ab cd, 12 ef" * 30_000 + " \t\n x" * 1000 + "z" * 150_000 + " end"
    big, kept = spark.createDataFrame([(1, "s", long)], "doc_id long, source string, text string"), mixing.PIECE
    whole = [mixing.token_counts(big).first().n_tokens]
    assert whole == [_plain_count(long)] and len(long) > 3 * kept
    assert n[1] == 2 and n[2] == 0 and n[3] == 0 and 60_000 <= n[4] <= 60_003
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(df.limit(0), targets)
    assert mix.count() == 0 and report.first().share_of_text == 0.0
    mix, report = mixing.mix_sources(df, targets)
    assert {r.doc_id for r in mix.collect()} == {1, 4} and report.first().share_of_text == 1.0
