import random
import unicodedata
from itertools import combinations

from ledgerloom.llm import lookalike
from ledgerloom.session import table
from tests.conftest import SMALL

CHARS = ["a", "e", "o", "А", "а", "е", "Ｆ", "ｆ", "１", "é", "é", "́", "̣", "̂", "​", " ", " ", "　", "­", "\n", "\t", "ё", "한", "한", "क़", "क", "़", "ñ", "ø", "ﬁ", "²", "“", "\U0001f600", "Å", "ộ"]


def form(text):
    """The form character by character, recomposed by the standard library."""
    return unicodedata.normalize("NFC", "".join(lookalike._form_of(ord(c)) for c in text))


def test_forms_of_random_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.form for r in lookalike.forms(df).collect()}
    for i, t in enumerate(texts):
        # canonically equal to the standard form, and equal texts get equal forms
        assert unicodedata.normalize("NFC", got[i]) == form(t), ascii(t)
    again = {r.doc_id: r.form for r in lookalike.forms(spark.createDataFrame(list(got.items()), "doc_id long, text string")).collect()}
    assert again == got


def test_pairs_against_brute_force(spark):
    t = table(spark, SMALL, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in t.collect()] + [(9001, "Café au lait"), (9002, "Café au lait"), (9003, "Ｃafé au lait"), (9004, "Cafe au lait"), (9005, "café au lait"), (9006, "Café au lait"), (9007, None), (9008, ""), (9009, "​"), (9010, "​​")]
    got = {tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = [(i, x, form(x)) for i, x in rows if x is not None]
    assert got == {tuple(sorted((a[0], b[0]))) for a, b in combinations(seen, 2) if a[2] == b[2] and a[1] != b[1]}
    assert {(9001, 9002), (9002, 9003), (9008, 9009), (9009, 9010)} <= got


def test_classes_long_texts_and_repeated_ids(spark):
    long = "х" * 20_000 + " plain " * 20_000
    rows = [(1, long), (1, long), (2, long.replace("х", "x")), (3, None)]
    got = sorted(tuple(r) for r in lookalike.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 2, 3), (1, 1, 2, 3), (2, 1, 2, 3)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lookalike.classes(empty).count() == lookalike.lookalike_pairs(empty).count() == lookalike.forms(empty).count() == 0
