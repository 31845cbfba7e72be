import os
import sys

import numpy as np
import pytest

from ledgerloom.llm import personal
from ledgerloom.llm.alert_texts import FOLDS, labelled_texts
from ledgerloom.llm.boosting import BoostedTrees

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import hand_texts  # noqa: E402


@pytest.fixture(scope="module")
def fitted():
    return personal.models()


def _scores(texts, fitted):
    found = personal.find_spans([t for t, _ in texts], fitted)
    for kind in personal.TYPES:
        true = {(i, s, e) for i, (_, spans) in enumerate(texts) for k, s, e in spans if k == kind}
        got = {(i, s, e) for i, spans in enumerate(found) for s, e, k in spans if k == kind}
        hit = len(true & got)
        print(f"{kind}: {len(true)} true, recall {hit / len(true):.3f}, precision {hit / max(1, len(got)):.3f}")
        yield kind, hit / len(true), hit / max(1, len(got))


def test_sentences_that_trees_have_not_seen(fitted):
    """Texts of the fold that only the thresholds were set on, with other words in their slots."""
    for kind, recall, precision in _scores(labelled_texts(800, 4242, FOLDS - 1), fitted):
        assert recall >= 0.93 and precision >= 0.93, kind


def test_hand_written_texts_of_other_wording(fitted):
    for kind, recall, precision in _scores(hand_texts.labelled(), fitted):
        assert recall >= 0.9 and precision >= 0.9, kind


def test_long_items_and_long_texts(fitted):
    houses = ", ".join(f"Block {c} Shanti Enclave" for c in "ABCDEFGHJK")
    address = f"Flat 7, {houses}, Temple Road, Navarpur 054823"
    text = f"Send it to {address}. " + "Balance is low. " * 5000 + "Mail anjali.verma@gmail.com now."
    assert len(address) > 250
    got = [(k, text[s:e]) for s, e, k in personal.find_spans([text], fitted)[0]]
    assert got == [("address", address), ("email", "anjali.verma@gmail.com")]


CASES = {
    "Dear Mr. Manjunath T Navvervi, call 520.710.2063 or (+91) 51581-45413.": {("person_name", "Manjunath T Navvervi"), ("phone", "520.710.2063"), ("phone", "(+91) 51581-45413")},
    "Write to chandrika.navnilo (at) letters.example.org. Something wrong? Toll-free 18000635614 or text STOP 6956 to 568648.": {("email", "chandrika.navnilo (at) letters.example.org")},
    "e-statement mailed to robert at postbox dot example. Thanks": {("email", "robert at postbox dot example")},
    "xx4998 paid ₹901.79 over UPI, 21-May-25, handle peldarkarres.k@sampl, beneficiary Peldarkar Restaurant, no. 565793363193. Nirvala Bank": set(),
    "KYC: PAN UCKXJ3850U verified. Aadhaar ending XXXX XXXX 9252 seeded. Folio 5716720122, order no 953671918094.": {("id_number", "UCKXJ3850U")},
    "Update Aadhaar no.: 0645-7263-2555 at the branch.": {("id_number", "0645-7263-2555")},
    "Cheque book sent to Door No 9-16, Green Acres, Marigold Road, Ambeghat. Nominee A. Verrune added.": {("address", "Door No 9-16, Green Acres, Marigold Road, Ambeghat"), ("person_name", "A. Verrune")},
    "Address on record: 47 Station Road, Surajnagar - 058777; tell us if it changed.": {("address", "47 Station Road, Surajnagar - 058777")},
}


def test_written_forms(spark, fitted):
    rows = list(enumerate(CASES)) + [(100, None), (101, ""), (102, "Balance low. " * 20_000 + "Call 5120710206"), (0, next(iter(CASES)))]
    df = spark.createDataFrame(rows, "alert_id long, text string")
    got = {}
    out = [tuple(r) for r in personal.personal_items(df).collect()]
    for i, kind, text in out:
        got.setdefault(i, set()).add((kind, text))
    for i, (text, want) in enumerate(CASES.items()):
        assert got.get(i, set()) == want, text
    assert got[102] == {("phone", "5120710206")} and 100 not in got and len(out) == len(set(out))
    red = {r.alert_id: r.redacted for r in personal.redacted_texts(df).collect()}
    assert red[0] == "Dear Mr. [PERSON_NAME], call [PHONE] or [PHONE]." and red[100] is None and red[101] == ""


def test_empty_table_and_clashing_columns(spark, fitted):
    assert personal.personal_items(spark.createDataFrame([], "alert_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "Call 5120710206", "x", "y")], "alert_id long, text string, items string, redacted string")
    assert personal.with_items(df).first().redacted == "Call [PHONE]"


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    m = BoostedTrees().fit(x[:2000], y[:2000]).calibrate(x[2000:], y[2000:])
    p = m.predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.85 and abs(p.mean() - y[2000:].mean()) < 0.05 and len(m.predict(x[:0])) == 0
