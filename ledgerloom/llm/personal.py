"""Personal information inside free text: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans of five types. For each type, boosted trees score a span by its format and by the kinds
of the words before and after it (words that announce a phone, an identity number, a reference, a person, ...), calibrated thresholds accept it, and
of overlapping accepted spans a name yields to any other, and else the likelier one stays (the longer one on a tie). Accepted spans become typed placeholders.

The trees are trained here, on ``TRAIN_TEXTS`` labelled texts written by a seeded generator (that many and no more; the bound is the
parameter of ``models``). The sentences of the texts are in folds: the trees see the odds of words learnt on other folds only, and the
thresholds are set on a fold of sentences that neither trees nor odds have seen. The trees take a few hundred kB at any input size.

Defined cases: a null text has no item and stays null; an empty one stays empty; texts of any length are read whole, and spans may be of any
length; repeated rows come out once for each id; each written form counts once for a text and type.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.alert_texts import FOLDS, labelled_texts
from ledgerloom.llm.boosting import BoostedTrees
from ledgerloom.llm.names import NICKNAMES, TITLES

TYPES = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}
TRAIN_TEXTS, HOLD_TEXTS = 3600, 1200

#: Words that announce a kind of item, and words of businesses, streets, houses and ordinary prose.
_CUES = {
    "phone": "call phone ph tel telephone mobile mob cell contact whatsapp sms ring dial reach text",
    "id": "pan aadhaar aadhar uid epic voter passport permanent election",
    "ref": "ref reference rrn utr arn txn transaction upi folio order invoice ticket auth code request mandate account acct ac policy loan cheque trace case consumer docket application receipt tracking entry biller rail customer request order parcel neft imps rtgs helpline toll free",
    "place": "address residence visit delivered located moved posted office pickup home lives sent to at from",
}
_CUE = {w: kind for kind, words in _CUES.items() for w in words.split()}
_BUSINESS = frozenset(
    """stores store mart motors traders trading electronics hardware textiles pharmacy hospital bakery restaurant jewellers builders services agencies agency enterprises opticals cafe sweets
    dairy farm foods furniture clinic salon travels tours studio tailors garage plumbing school academy book books house fuels petroleum laundry florist stationery toys logistics medicals medical provision
    limited ltd private pvt sons company co brothers bros bank payments finance trust card insurance shop hotel market supermarket centre center industries solutions systems associates llp inc corp""".split()
)
_PLAIN = frozenset(
    """dear hello hi respected attn account amount alert balance card cash charged your you yours the this that our we us they his her its my payment paid pay payee purchase sum when where spent left auth code date
    reference ref remarks request order mandate nominee courier delivery visit guarantor holder joint registered mobile phone call ring write reply email mail queries query note address record update kyc pan aadhaar uid epic
    voter passport folio ticket toll free never always visit branch invoice approved reminder incoming outgoing credited debited credit debit money transfer neft imps rtgs upi utr rrn atm pos emi bill due thank thanks sent send
    received refund salary rent customer care help something wrong dispute text stop type dial contact agent manager officer relationship merchant beneficiary sender value available limit not block open check hi regards signed witness tenant
    rider passenger statement documents document proof identity seen by from to at of for with and or on in is was will has have if no yes january february march april may june july august september october november december
    jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday inr rs usd autopay standing recurring collect funds loan cheque mr login bills parcel residence kindly please ask speak use""".split()
)
_STREET = re.compile(r"\b(?:road|street|lane|marg|avenue|cross|path|row|extension|chowk|layout|nagar|gali|rd|st|main|bazaar|circle|highway|sector)\b", re.I)
_HOUSE = re.compile(r"\b(?:residency|apartments?|towers?|niwas|heights|enclave|villa|block|acres|gardens?|chawl|kunj|society|colony|chambers|complex|park|building|house)\b", re.I)
_GIVEN = frozenset(w for g, short in NICKNAMES.items() for w in (g, *short.split()))

_LINKS = frozenset("of and near opp opp. off no main".split())
_PROSE = frozenset(w for w in _PLAIN - _LINKS if not _STREET.fullmatch(w) and not _HOUSE.fullmatch(w))

_EMAIL = re.compile(r"[A-Za-z0-9][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*")
_SPELLED = re.compile(r"[A-Za-z0-9][\w.%+\-]*(?: ?\(?\bdot\b\)? ?[\w.%+\-]+)* ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9\-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9\-]+)+", re.I)
_RUN = re.compile(r"(?<![\w@*+.\-/])(?:\(\+?\d{1,4}\)|\+?\d)(?:[\d.\-() ]*\d)?(?!\w)")
_ID = re.compile(r"(?<!\w)(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}\d{7}|[A-Z]\d{7}|\d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}|\d{12})(?!\w)", re.I)
_UNIT = re.compile(r"(?<![\w/.,\-])(?:(?:flat|house|plot|door|apt|unit|shop|room|villa|h\. ?no|d\. ?no|hno|no)\b\.?(?: ?(?:no|number)\b\.?)?[:#]? ?(?:[A-Za-z]{1,2}[\-/ ]?)?\d\w*|[A-Z]{1,2}[\-/]\d\w*|\d{1,5}[A-Za-z]?)(?:[/\-]\w+)*(?=,? )", re.I)
_CODE = re.compile(r"(?: ?- ?|,? )(?:\d{6}|\d{3} \d{3})(?!\d)")
_STOP = re.compile(r"[;\n\[\]:?!@₹*|]|(?<!\b[Ss]t)(?<!\b[Rr]d)(?<!\b[Nn]o)(?<!\b[Oo]pp)\.(?=\s|$)|$")
_PLACE_WORD = re.compile(r"(,?) ?([^\s,]+)")
_NAME_TOKEN = re.compile(r"[A-Za-z][A-Za-z'’]*")
_WORD = re.compile(r"[A-Za-z]+|\d+")
_BEFORE = 8


class _Text:
    """A text with its words, found once for all spans: the words before and after a place come from their positions."""

    __slots__ = ("s", "low", "starts", "words", "names")

    def __init__(self, s: str):
        self.s, self.low = s, s.lower()
        found = [(m.start(), m.group().lower()) for m in _WORD.finditer(s)]
        self.starts, self.words = [a for a, _ in found], [w for _, w in found]

    def before(self, at: int, n: int) -> list[str]:
        """Up to n words before a place, the nearest first."""
        i = bisect_left(self.starts, at)
        return self.words[max(0, i - n) : i][::-1]

    def after(self, at: int) -> str:
        i = bisect_left(self.starts, at)
        return self.words[i] if i < len(self.words) else "$"


def _emails(t: _Text) -> Iterator[tuple[int, int]]:
    if "@" in t.s:
        for m in _EMAIL.finditer(t.s):
            yield m.start(), m.end()
    if " at " in t.low or "at)" in t.low or "at]" in t.low or "at}" in t.low:
        for m in _SPELLED.finditer(t.s):
            yield m.start(), m.end()


def _phones(t: _Text) -> Iterator[tuple[int, int]]:
    """Runs of digit groups with 9 to 15 digits, the most a telephone number may have."""
    text = t.s
    for m in _RUN.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start()) for p in re.finditer(r"\S+", m.group())]
        for i, (s, _) in enumerate(parts):
            for _, e in parts[i:]:
                while e > s and text[e - 1] in ".-(":
                    e -= 1
                n = sum(c.isdigit() for c in text[s:e])
                if n > 15:
                    break
                if n >= 9 and text[s:e].count("(") == text[s:e].count(")"):
                    yield s, e


def _ids(t: _Text) -> Iterator[tuple[int, int]]:
    for m in _ID.finditer(t.s):
        yield m.start(), m.end()


def _addresses(t: _Text) -> Iterator[tuple[int, int]]:
    """From each unit to each end of a word that may close an address: as far as words are capitals or numbers, and to the first postal code at most."""
    text = t.s
    for m in _UNIT.finditer(text):
        at, limit = m.end(), -1
        words = 0
        while (w := _PLACE_WORD.match(text, at)) and w.end() > at:
            if limit < 0:
                limit = _STOP.search(text, at).start()
            code = _CODE.match(text, at)
            if code and words:
                yield m.start(), code.end()
                break
            if w.start(2) >= limit or not (w.group(2)[0].isupper() or w.group(2)[0].isdigit()) and w.group(2) not in _LINKS or w.group(2).lower() in _PROSE:
                break
            end = min(w.end(), limit)
            words += 1
            yield m.start(), end
            at = end


def _names(t: _Text) -> Iterator[tuple[int, int]]:
    """Sequences of capitalised words and initials that hold no business word, title or ordinary word: those of up to five words, and whole runs of any length."""
    text, run = t.s, []

    def spans() -> Iterator[tuple[int, int]]:
        for i in range(len(run)):
            for j in {*range(i + 1, min(i + 5, len(run))), len(run) - 1} if i == 0 else range(i + 1, min(i + 5, len(run))):
                if j > i and any(e - s > 1 for s, e in run[i : j + 1]):
                    end = run[j][1]
                    yield run[i][0], end + 1 if end - run[j][0] == 1 and text[end : end + 1] == "." else end

    last = -9
    for m in _NAME_TOKEN.finditer(text):
        s, e = m.span()
        w = m.group()
        low = w.lower()
        fit = (w[0].isupper() or low in _GIVEN) and low not in _PLAIN and low not in _BUSINESS and low not in TITLES
        fit = fit and not (s and (text[s - 1].isalnum() or text[s - 1] in "@_*") or e < len(text) and (text[e].isalnum() or text[e] in "@_"))
        gap = text[last:s] if run else ""
        if run and not (fit and (gap == " " or gap in (". ", ".") and last - run[-1][0] == 1)):
            yield from spans()
            run = []
        if fit:
            run.append((s, e))
            last = e
    yield from spans()


_GENERATORS = {"email": _emails, "phone": _phones, "id_number": _ids, "address": _addresses, "person_name": _names}
_KINDS = tuple(_CUES)


def _cues(t: _Text, s: int, kinds: tuple[str, ...] = ("phone", "id", "ref")) -> list[float]:
    """Which kind of cue stands nearest among the eight words before a place: in its own sentence, and at all."""
    out = [0.0] * (2 * len(kinds))
    i = bisect_left(t.starts, s)
    for k in range(i - 1, max(-1, i - 1 - _BEFORE), -1):
        kind = _CUE.get(t.words[k])
        if kind in kinds:
            own = not re.search(r"[;\n?!]|[.:,](?=\s+[A-Z])", t.s[t.starts[k] : s].rstrip()) if kind != "place" else True
            out[kinds.index(kind)] = float(own)
            out[len(kinds) + kinds.index(kind)] = 1.0
            break
    return out


def _format(kind: str, t: _Text, s: int, e: int) -> list[float]:
    text = t.s
    span, before, after = text[s:e], text[s - 1 : s], text[e : e + 1]
    f: list = [e - s, span.isupper(), before in ("", " ", "\n"), before in ("(", "["), after in ("", " ", ",", ";", ".", "\n", ")")]
    if kind == "email":
        low = span.lower()
        domain = re.split(r"@|\(at\)|\[at\]|\{at\}| at ", low)[-1]
        f += ["." in domain, "dot" in domain, "(at)" in low or "[at]" in low, "@" in span, low.count(" "), ". " in domain, span[-1:].isdigit(), "www" in low, ". " in span]
    elif kind == "phone":
        d = re.sub(r"\D", "", span)
        groups = re.findall(r"\d+", span)
        national = d[2:] if d.startswith("91") and len(d) == 12 else d[1:] if d.startswith("0") and len(d) == 11 else d
        date = bool(re.search(r"\d{4}-\d\d-\d\d|\d\d[-/]\d\d[-/]\d{2,4}", span))
        f += [len(d), "+" in span, "(" in span, d[0] == "0", d.startswith(("1800", "1860")), len(national) == 10, len(groups), max(map(len, groups)), min(map(len, groups)), "-" in span, "." in span, " " in span, date, int(national[:1] or 0)]
        f += [bool(re.match(r"[ ]?[\d+(]", text[e : e + 2])), bool(re.search(r"\d\)?[ .\-]?$", text[max(0, s - 3) : s])), *_cues(t, s)]
        # beside a person's name
        b = t.before(s, 1)
        f += [bool(re.search(r"[A-Za-z], $", text[max(0, s - 3) : s])), bool(b) and b[0] not in _PLAIN and b[0] not in _BUSINESS and b[0] not in _CUE and b[0].isalpha(), text[e : e + 2] == ", ", before == "("]
    elif kind == "id_number":
        d = sum(c.isdigit() for c in span)
        f += [d, span[:1].isalpha(), span[-1:].isalpha(), " " in span, "-" in span, len(span) - d, d == 12 and len(span) == 12, *_cues(t, s)]
    elif kind == "address":
        parts = [p.strip() for p in span.split(",")]
        last = parts[-1]
        bare = re.sub(r"[ \-]*(?:\d{6}|\d{3} \d{3})$", "", last) or (parts[-2] if len(parts) > 1 else "")
        code = len(bare) < len(last) or bool(re.fullmatch(r"\d{6}|\d{3} \d{3}", last))
        back = bool(re.search(r"(?:flat|house|plot|door|no|no\.|shop)[ .:]*$", text[max(0, s - 10) : s], re.I))
        follows = re.match(r",? ([A-Z0-9])", text[e : e + 3])
        f += [len(parts), span[0].isalpha(), code, bool(_CODE.match(text, e)), bool(_STREET.search(span)), bool(_HOUSE.search(span)), bool(_STREET.search(last)), bool(_HOUSE.search(last)), len(bare.split()), bare[:1].isupper(), bare.isupper(), any(c.isdigit() for c in bare), back]
        f += [bool(follows), after == ",", after == " ", bool(_STREET.search(span.rpartition(",")[0])), bool(re.match(r" [a-z]", text[e : e + 2])), bool(re.match(r"[.;](?:\s|$)", text[e : e + 2])) or not after, t.after(e) in _PLAIN, len(parts[0].split()), *_cues(t, s, ("place", "ref"))]
    else:
        words = [w.lower() for w in _NAME_TOKEN.findall(span)]
        given = [w in _GIVEN for w in words]
        b = t.before(s, 1)
        prev, nxt = b[0] if b else "^", t.after(e)
        beside = before == " " and text[max(0, s - 2) : s - 1].isalpha()
        runs_on = bool(re.match(r"\.? [A-Z]", text[e : e + 3]))
        f += [len(words), sum(given), given[0], given[-1], sum(len(w) == 1 for w in words), len(words[0]) == 1, len(words[-1]) == 1, prev in TITLES, beside and bool(re.match(r"[A-Z]", text[max(0, text.rfind(" ", 0, s - 1)) + 1 :])), prev in _GIVEN and before == " ", prev in _PLAIN]
        f += [runs_on, nxt in _BUSINESS and after in (" ", ""), nxt in ("and", "n") and after == " ", after == "&" or text[e : e + 2] == " &", nxt in _GIVEN and after == " ", nxt in _PLAIN, min(map(len, words)), max(map(len, words)), all(w.istitle() or len(w) == 1 for w in span.split(" "))]
        f += [len(prev) == 1 and before in " ." and beside, len(nxt) == 1 and after == " "]
        # words further on in the run: a business may name its trade only after some words
        i = bisect_left(t.starts, e)
        f += [any(w in _BUSINESS for w in t.words[i : i + 3]), not s or bool(re.search(r"[.!?:;\n]\s*$", text[max(0, s - 3) : s])), len(given) > 1 and given[1], len(words) > 2]
    return [float(x) for x in f]


class _Evidence:
    """Smoothed log odds of the words in and around a name, learnt from labelled texts."""

    def __init__(self):
        self.odds: dict[tuple[int, str], float] = {}

    @staticmethod
    def keys(t: _Text, s: int, e: int) -> list[tuple[int, str]]:
        near = t.before(s, 2) + ["^", "^"]
        words = [w.lower() for w in _NAME_TOKEN.findall(t.s[s:e])]
        return [(0, near[0]), (1, near[1]), (2, t.after(e)), (3, words[0]), (3, words[-1])]

    def learn(self, rows: list[tuple[list[tuple[int, str]], int]]) -> _Evidence:
        yes, no = Counter(), Counter()
        for keys, label in rows:
            (yes if label else no).update(keys)
        n1, n0 = sum(label for _, label in rows), sum(1 - label for _, label in rows)
        for k in yes.keys() | no.keys():
            if yes[k] + no[k] >= 8:
                self.odds[k] = float(np.log((yes[k] + 2) / (n1 + 4)) - np.log((no[k] + 2) / (n0 + 4)))
        return self

    def of(self, keys: list[tuple[int, str]]) -> list[float]:
        return [self.odds.get(k, 0.0) for k in keys]


@lru_cache(2)
def models(train_texts: int = TRAIN_TEXTS, hold_texts: int = HOLD_TEXTS, seed: int = 11) -> dict[str, tuple[_Evidence, BoostedTrees]]:
    """For each type its evidence and trees, fit on ``train_texts`` texts of all folds but the last and calibrated on ``hold_texts`` texts of the last."""
    folds = [[(_Text(t), spans) for t, spans in labelled_texts(train_texts // (FOLDS - 1), seed + k, k)] for k in range(FOLDS - 1)]
    folds.append([(_Text(t), spans) for t, spans in labelled_texts(hold_texts, seed + FOLDS, FOLDS - 1)])
    out = {}
    for kind in TYPES:
        named = kind == "person_name"
        rows = []
        for texts in folds:
            rows.append([])
            for t, spans in texts:
                true = {(s, e) for k, s, e in spans if k == kind}
                rows[-1] += [(_format(kind, t, s, e), _Evidence.keys(t, s, e) if named else [], int((s, e) in true)) for s, e in dict.fromkeys(_GENERATORS[kind](t))]
        evidence = _Evidence()
        if named:
            evidence.learn([(k, y) for part in rows[:-1] for _, k, y in part])
        x, y = [], []
        for i, part in enumerate(rows[:-1]):
            # the words of each fold are judged by what the other folds teach
            others = _Evidence().learn([(k, v) for j, p in enumerate(rows[:-1]) if j != i for _, k, v in p]) if named else evidence
            x += [f + others.of(k) for f, k, _ in part]
            y += [v for *_, v in part]
        trees = BoostedTrees().fit(np.array(x), np.array(y, float))
        trees.calibrate(np.array([f + evidence.of(k) for f, k, _ in rows[-1]]), np.array([v for *_, v in rows[-1]], float))
        out[kind] = (evidence, trees)
    return out


def find_spans(texts: list[str | None], fitted: dict[str, tuple[_Evidence, BoostedTrees]]) -> list[list[tuple[int, int, str]]]:
    """For each text the accepted spans (start, end, type), without overlaps, in order."""
    scored: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    read = [_Text(t) if t else None for t in texts]
    for kind in TYPES:
        evidence, trees = fitted[kind]
        named = kind == "person_name"
        where, feats, seen = [], [], []
        index: dict[tuple, int] = {}
        for i, t in enumerate(read):
            for s, e in dict.fromkeys(_GENERATORS[kind](t)) if t else ():
                f = _format(kind, t, s, e)
                if named:
                    f += evidence.of(_Evidence.keys(t, s, e))
                # spans that look alike are scored once
                seen.append(index.setdefault(tuple(f), len(index)))
                if len(feats) < len(index):
                    feats.append(f)
                where.append((i, s, e))
        if not where:
            continue
        p = trees.predict(np.array(feats))
        for (i, s, e), q in zip(where, p[seen].tolist()):
            if q >= trees.threshold:
                scored[i].append((q, s, e, kind))
    out = []
    for spans in scored:
        kept: list[tuple[int, int, str]] = []
        for _, s, e, kind in sorted(spans, key=lambda x: (x[3] == "person_name", -round(x[0], 3), x[1] - x[2], x[1])):  # a name inside an address is part of it
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, kind))
        out.append(sorted(kept))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


def with_items(rows: DataFrame, text: str = "text", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """``rows`` with items (array of pii_type, pii_text) and redacted."""
    sent = rows.sparkSession.sparkContext.broadcast(models(train_texts))

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            found = []
            for at in range(0, len(values), 1000):
                found += find_spans(values[at : at + 1000], sent.value)
            yield pd.DataFrame({"items": [[{"pii_type": k, "pii_text": t[s:e]} for s, e, k in spans] for t, spans in zip(values, found)], "redacted": [None if t is None else redact(t, spans) for t, spans in zip(values, found)]})

    seen = F.pandas_udf(scan, "items array<struct<pii_type: string, pii_text: string>>, redacted string")
    own = [c for c in rows.columns if c.lower() not in ("items", "redacted", "_seen")]
    return rows.select(*own).withColumn("_seen", seen(F.col(text))).select(*own, "_seen.items", "_seen.redacted")


def personal_items(rows: DataFrame, row_id: str = "alert_id", text: str = "text") -> DataFrame:
    """row_id, pii_type, pii_text: each item as written, once for a row, type and form."""
    seen = with_items(rows.select(row_id, text), text)
    return seen.select(row_id, F.explode(F.array_distinct("items")).alias("x")).select(row_id, "x.pii_type", "x.pii_text").distinct()


def redacted_texts(rows: DataFrame, row_id: str = "alert_id", text: str = "text") -> DataFrame:
    """row_id, redacted, n_items."""
    return with_items(rows.select(row_id, text), text).select(row_id, "redacted", F.size("items").alias("n_items"))
