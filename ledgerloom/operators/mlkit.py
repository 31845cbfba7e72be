"""Scoring, labelling and decoding of extracted alerts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions.text import clean_name

FIELDS = ("direction", "amount_paise", "ref", "own_acct_tail", "cpty_acct_tail", "date_iso", "balance_paise")
CORE = ("direction", "amount_paise", "own_acct_tail", "ref")


def _bucket(gold: Column, pred: Column) -> Column:
    return F.when(gold.eqNullSafe(pred), "correct").when(pred.isNull(), "missing").when(gold.isNull(), "spurious").otherwise("wrong")


def _party(payee: str, vpa: str) -> Column:
    return F.array_distinct(F.array_compact(F.array(F.nullif(F.lower(clean_name(F.col(payee))), F.lit("")), F.nullif(F.lower(vpa), F.lit("")))))


def _joined(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold records with their predictions, an absent one as empty. Both have id, is_txn, the fields, payee and vpa."""
    names = ("is_txn", *FIELDS, "payee", "vpa")
    g = gold.select("id", "channel", *(F.col(c).alias(f"g_{c}") for c in names))
    p = pred.dropDuplicates(["id"]).select("id", *(F.col(c).alias(f"p_{c}") for c in names))
    x = g.join(p, "id", "left").withColumn("p_is_txn", F.coalesce("p_is_txn", F.lit(False)))
    return x.select("id", "channel", "g_is_txn", "p_is_txn", *(F.col(f"g_{c}") for c in names[1:]), *(F.when(F.col("p_is_txn"), F.col(f"p_{c}")).alias(f"p_{c}") for c in names[1:]))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over is_txn."""
    g, p = F.col("g_is_txn"), F.col("p_is_txn")
    return _joined(gold, pred).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def field_buckets(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """For each field of true payments: correct, missing, wrong, spurious and present."""
    x = _joined(gold, pred).where("g_is_txn")
    gc, pc = _party("g_payee", "g_vpa"), _party("p_payee", "p_vpa")
    none = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(a), "|"))
    party = F.when(F.arrays_overlap(gc, pc), "correct").otherwise(_bucket(none(gc), none(pc)))
    each = [F.struct(F.lit(f).alias("field"), _bucket(F.col(f"g_{f}"), F.col(f"p_{f}")).alias("bucket"), F.col(f"g_{f}").isNotNull().alias("present")) for f in FIELDS]
    each.append(F.struct(F.lit("counterparty").alias("field"), party.alias("bucket"), (F.size(gc) > 0).alias("present")))
    y = x.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    return y.groupBy("field").agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in ("correct", "missing", "wrong", "spurious")), F.count_if("present").alias("present"))


def core_exact(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Payments of each channel and those with all core fields right."""
    ok = F.lit(True)
    for f in CORE:
        ok = ok & F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}"))
    return _joined(gold, pred).where("g_is_txn").groupBy("channel").agg(F.count_if(ok).alias("exact"), F.count("*").alias("n"))


def label_counts(records: DataFrame) -> DataFrame:
    """label, n over spans (array of start, end, label)."""
    return records.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def occurrence_ids(records: DataFrame, row_id: str, order: Sequence[str]) -> DataFrame:
    """Ids made unique: the n-th record with an id gets the suffix -n from the second on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(row_id).orderBy(*order))
    return records.withColumn("_n", n).withColumn(row_id, F.when(F.col("_n") > 1, F.concat(F.col(row_id), F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(row_id))).drop("_n")


#: Amounts, references and dates as an extractor's spans write them.
STRICT_AMOUNT = r"^(?:\d+|\d{1,2}(?:,\d{2})*,\d{3}|\d{1,3}(?:,\d{3})+)(?:\.\d{1,2})?$"
STRICT_REFERENCE = (r"^\d{12}$", r"^[A-Z]{4}(?:[A-Z0-9]{12}|[A-Z0-9]{18})$", r"^[A-Z](?:\d{15}|\d{21})$")
FULL_MONTHS = "january february march april may june july august september october november december".split()


def strict_amount(span: Column) -> Column:
    """Paise of a span that is an amount and nothing else; null beyond BIGINT."""
    s = F.regexp_replace(F.btrim(span), "/-$", "")
    plain = F.replace(s, F.lit(","), F.lit(""))
    return F.when(s.rlike(STRICT_AMOUNT), F.concat(F.split_part(plain, F.lit("."), F.lit(1)), F.rpad(F.split_part(plain, F.lit("."), F.lit(2)), 2, "0")).try_cast("bigint"))


def strict_reference(span: Column) -> Column:
    s = F.upper(F.btrim(span))
    known = s.rlike(STRICT_REFERENCE[0]) | s.rlike(STRICT_REFERENCE[1]) | s.rlike(STRICT_REFERENCE[2])
    return F.when(known & (F.length(F.regexp_replace(s, "[^0-9]", "")) >= 8), s)


def strict_date(span: Column) -> Column:
    """yyyy-MM-dd, or --MM-dd where no year is written; null if it is no day."""
    s = F.regexp_replace(F.lower(F.btrim(span)), r"(\d)(?:st|nd|rd|th)\b", "$1")
    s = F.btrim(F.regexp_replace(F.replace(s, F.lit("'"), F.lit(" ")), r"\s+", " "))
    part = lambda p, i: F.regexp_extract(s, p, i)
    num = lambda c: c.try_cast("int")
    abbr = lambda c: F.when(F.length(c) == 3, dates.month_number(c))
    named = lambda c: F.nullif(F.array_position(F.array(*(F.lit(m) for m in FULL_MONTHS)), c), F.lit(0)).cast("int")

    def year(c: Column) -> Column:
        y = num(c)
        return F.when(F.length(c) == 4, y).when(y >= 69, 1900 + y).otherwise(2000 + y)

    def iso(pattern: str, y: Column, m: Column, d: Column) -> Column:
        return F.when(s.rlike(pattern), F.date_format(dates.made(y, m, d), "yyyy-MM-dd"))

    def short(pattern: str, m: Column, d: Column) -> Column:
        # a leap year, so 29 February may stand
        return F.when(s.rlike(pattern), F.concat(F.lit("--"), F.date_format(dates.made(F.lit(2000), m, d), "MM-dd")))

    p = [r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2}|\d{4})$", r"^(\d{1,2})-([a-z]{3})-(\d{2}|\d{4})$", r"^(\d{1,2})([a-z]{3})(\d{2}|\d{4})$", r"^(\d{1,2}) ([a-z]{3}) (\d{2}|\d{4})$", r"^(\d{1,2})([- ])([a-z]+)\2(\d{4})$", r"^([a-z]{3}) (\d{1,2}), (\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"]
    q = [r"^(\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[- ]?([a-z]{3})$", r"^([a-z]{3}) (\d{1,2})$"]
    return F.coalesce(
        iso(p[0], year(part(p[0], 4)), num(part(p[0], 3)), num(part(p[0], 1))), *(iso(x, year(part(x, 3)), abbr(part(x, 2)), num(part(x, 1))) for x in p[1:4]), iso(p[4], num(part(p[4], 4)), named(part(p[4], 3)), num(part(p[4], 1))),
        iso(p[5], num(part(p[5], 3)), abbr(part(p[5], 1)), num(part(p[5], 2))), iso(p[6], num(part(p[6], 1)), num(part(p[6], 2)), num(part(p[6], 3))),
        short(q[0], num(part(q[0], 2)), num(part(q[0], 1))), short(q[1], abbr(part(q[1], 2)), num(part(q[1], 1))), short(q[2], abbr(part(q[2], 1)), num(part(q[2], 2))),
    )


def split_tokens(text: str) -> list[tuple[int, int]]:
    """Words, single digits and single signs of a text, as places."""
    return [m.span() for m in re.finditer(r"[^\W\d_]+|\d|[^\w\s]|_", text)]


def pieces(text: str, vocabulary: dict[str, int], longest: int = 192) -> list[tuple[int, int, int]]:
    """(id, start, end) of the longest known pieces of each token; [UNK] where none fits, cut at ``longest`` with both ends marked."""
    out = []
    for s, e in split_tokens(text):
        at, word, found = s, text.lower(), []
        while at < e:
            end = e
            while end > at and ("##" if at > s else "") + word[at:end] not in vocabulary:
                end -= 1
            if end == at:
                found = [(vocabulary["[UNK]"], s, e)]
                break
            found.append((vocabulary[("##" if at > s else "") + word[at:end]], at, end))
            at = end
        out += found
    out = out[: longest - 2]
    return [(vocabulary["[CLS]"], 0, 0), *out, (vocabulary["[SEP]"], 0, 0)]


#: The tag of tokens that stand for no text; training passes over them.
IGNORED = "ignored"


def bio_encode(spans: Sequence[tuple[int, int, str]], offsets: Sequence[tuple[int, int]]) -> tuple[list[str], int, int]:
    """Tags of the tokens, the number of spans whose edges are no token edges, and of spans that begin beyond the last token.

    A token that begins inside a span is of it, the last span in order if several; the first such token of a span is its B.
    """
    begin, end = np.array([*offsets, (0, 0)], int).T
    real = end > begin
    wanted = pd.DataFrame(list(spans), columns=["start", "end", "label"])
    beyond = wanted["start"] >= end.max()
    kept = wanted[~beyond].reset_index(drop=True)
    exact = kept["start"].isin(begin[real]) & kept["end"].isin(end[real])
    tags = pd.Series(np.where(real, "O", IGNORED))
    if len(kept):
        inside = real & (begin >= kept[["start"]].to_numpy()) & (begin < kept[["end"]].to_numpy())
        owner = np.where(inside, np.arange(len(kept))[:, None], -1).max(0)
        held = owner >= 0
        first = inside.argmax(1)[owner] == np.arange(len(begin))
        tags[held] = np.where(first, "B-", "I-")[held].astype(object) + kept["label"].to_numpy()[owner[held]]
    return tags.tolist()[:-1], int((~exact).sum()), int(beyond.sum())


#: What a value may not begin in the middle of, and what it may not end in the middle of: a number keeps its separators, and a value may begin at
#: digits after letters but not end there.
_UNBROKEN_FROM, _UNBROKEN_TO = re.compile(r"[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*"), re.compile(r"[A-Za-z0-9]+(?:(?<=[0-9])[.,](?=[0-9])[A-Za-z0-9]+)*")


def clean_edges(text: str, start: int, end: int) -> bool:
    """Whether a span begins and ends at the edges of whole words and numbers."""
    cut = lambda units, at: any(m.start() < at < m.end() for m in units.finditer(text))
    return not cut(_UNBROKEN_FROM, start) and not cut(_UNBROKEN_TO, end)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def spans_of(offsets: Sequence[tuple[int, int]], probs: np.ndarray, tags: Sequence[str]) -> list[tuple[str, int, int, float]]:
    """(label, start, end, mean probability) of the tagged runs: a run begins at a B and wherever the label is another than that of the token before."""
    best = probs.argmax(1)
    t = pd.DataFrame(list(offsets), columns=["start", "end"]).assign(tag=[tags[k] for k in best], p=probs.max(1))
    t["label"] = t["tag"].str[2:].where((t["end"] > t["start"]) & (t["tag"] != "O"), "")
    t["run"] = (t["tag"].str.startswith("B") | (t["label"] != t["label"].shift(fill_value=""))).cumsum()
    runs = t[t["label"] != ""].groupby("run").agg(label=("label", "first"), start=("start", "first"), end=("end", "last"), p=("p", "mean"))
    return list(runs.itertuples(index=False, name=None))


def bio_decode(rows: DataFrame, tags: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """id, cls, confidence and the best clean span of each label (map). ``rows`` has id, text, offsets, tag_logits, class_logits."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, offsets, logits, cls in pdf[["id", "text", "offsets", "tag_logits", "class_logits"]].itertuples(index=False, name=None):
                p = _soft(np.array(list(cls), float))
                best: dict[str, tuple[float, str]] = {}
                places = [(o["start"], o["end"]) if isinstance(o, dict) else tuple(o) for o in offsets]
                for label, s, e, q in spans_of(places, _soft(np.array([list(r) for r in logits], float)), tags):
                    if clean_edges(text, s, e) and (label not in best or q > best[label][0]):
                        best[label] = (q, text[s:e])
                out.append((i, classes[int(p.argmax())], round(float(p.max()), 4), {k: v for k, (_, v) in sorted(best.items())}))
            yield pd.DataFrame(out, columns=["id", "cls", "confidence", "spans"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text", "offsets", "tag_logits", "class_logits").mapInPandas(decode, f"id {kind}, cls string, confidence double, spans map<string,string>")


def extracted(decoded: DataFrame) -> DataFrame:
    """Fields of decoded alerts through the strict readers; without an amount it is no payment."""
    at = lambda k: F.col("spans")[k]
    x = decoded.withColumns({"amount_paise": strict_amount(at("AMOUNT")), "balance_paise": strict_amount(at("BALANCE")), "ref": strict_reference(at("REF")), "date_iso": strict_date(at("DATE")), "payee": F.nullif(F.btrim(at("PAYEE")), F.lit("")), "vpa": F.nullif(F.lower(F.btrim(at("VPA"))), F.lit(""))})
    return x.withColumn("is_txn", (F.col("cls") != "none") & (F.coalesce("amount_paise", F.lit(0)) > 0)).withColumn("direction", F.when(F.col("is_txn"), F.col("cls")))


def grounded(text: str, said: Sequence[tuple[str, set[int]]]) -> bool:
    """Whether each rupee figure of a text was said about something it names, or about the whole where it names nothing."""
    figures = {round(float(m.replace(",", ""))) for m in re.findall(r"(?:₹|\brs\.?|\binr)\s*(\d[\d,]*(?:\.\d+)?)", text, re.I)}
    low = text.lower()
    named = [s for s, _ in said if s and s.lower() in low]
    about = [(s, n) for s, n in said if (s in named if s else not named or re.search(r"\b(total|overall|all spending)\b", low))]
    return all(any(f in n for _, n in about) for f in figures) and all(any(s == k and n & figures for s, n in said) for k in named if figures)


def to_records(annotated: DataFrame) -> DataFrame:
    """id, text, spans, problem of annotated texts (text, kind, labels: array of label, value, nth).

    A value is the n-th occurrence of a substring. problem tells a value that is not there, has blank edges or cuts a longer word or
    number, and spans on a text that is no payment.
    """
    out = "struct<spans: array<struct<start: int, end: int, label: string>>, problem: string>"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for text, kind, labels in pdf.itertuples(index=False, name=None):
            spans, problem = [], None if kind in ("debit", "credit", "none") else "kind"
            for item in labels if labels is not None else []:
                label, value, nth = item["label"], item["value"], item["nth"]
                nth = 1 if nth is None or nth != nth else int(nth)
                at = -1
                for _ in range(nth):
                    at = text.find(value, at + 1)
                    if at < 0:
                        break
                if at < 0:
                    problem = problem or f"{label} not found"
                elif not value or value != value.strip():
                    problem = problem or f"{label} has blank edges"
                elif not clean_edges(text, at, at + len(value)):
                    problem = problem or f"{label} cuts a word or number"
                else:
                    spans.append({"start": at, "end": at + len(value), "label": label})
            if kind == "none" and spans:
                problem = problem or "spans without a payment"
            got.append((sorted(spans, key=lambda s: s["start"]), problem))
        return pd.DataFrame(got, columns=["spans", "problem"])

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield place(pd.concat(cols, axis=1))

    rec = annotated.withColumn("_r", F.pandas_udf(run, out)("text", "kind", "labels"))
    return rec.select(F.concat(F.lit("real-"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 10)).alias("id"), "text", "kind", "_r.spans", "_r.problem")


def label_batches(batch: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with their labels by id, and labels whose id no message has."""
    return batch.join(labels, "id", "left"), labels.join(batch.select("id"), "id", "left_anti")


def split_of(records: DataFrame, key: str, parts: int = 8) -> DataFrame:
    """``records`` with split: one part in ``parts`` for test, one for val, the rest for train, by a digest of the key (whole formats stay together)."""
    from ledgerloom.functions.ident import hash_split

    n = hash_split(F.col(key), parts)
    return records.withColumn("split", F.when(n == 0, "test").when(n == 1, "val").otherwise("train"))


def write_splits(records: DataFrame, path: str) -> DataFrame:
    """JSON lines in a folder for each split; returns the manifest (split, n)."""
    records.write.mode("overwrite").partitionBy("split").json(path)
    return records.groupBy("split").agg(F.count("*").alias("n"))


#: Templates of generated alerts: kind, channel and text with slots.
TEMPLATES = (
    ("debit", "sms", "{BANK}: {AMOUNT} debited from a/c {OWN_ACCT} to {PAYEE} on {DATE}. Ref {REF}"), ("credit", "sms", "{AMOUNT} credited to a/c {OWN_ACCT} by {PAYEE} on {DATE}. UTR {REF}. Bal {BALANCE}"), ("debit", "email", "You paid {AMOUNT} to {PAYEE} ({VPA}) on {DATE}. UPI ref {REF}"),
    ("credit", "notification", "Received {AMOUNT} from {VPA} in {OWN_ACCT}"), ("none", "sms", "{BANK}: {AMOUNT} is due on {DATE}. Pay in the app"), ("none", "sms", "{BANK} will never ask for your OTP"),
)


def generate_alerts(spark, n: int, seed: int = 0) -> DataFrame:
    """id, text, kind, channel, template_id, spans of ``n`` alerts; each row is made from its own seed, so any partitioning gives the same rows."""
    schema = "id string, text string, kind string, channel string, template_id string, spans array<struct<start: int, end: int, label: string>>"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                r = random.Random(seed * 1_000_003 + i)
                k = r.randrange(len(TEMPLATES))
                kind, channel, template = TEMPLATES[k]
                word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
                day = f"{r.randint(1, 28):02}"
                slots = {"BANK": lambda: word().title() + " Bank", "AMOUNT": lambda: f"{r.choice(['Rs.', 'INR ', '₹'])}{r.randint(1, 99999):,}.{r.randint(0, 99):02}", "BALANCE": lambda: f"Rs.{r.randint(1, 999999)}.00", "OWN_ACCT": lambda: f"XX{r.randint(0, 9999):04}", "PAYEE": lambda: f"{word()} {word()}".title(), "DATE": lambda: r.choice([f"{day}-{r.randint(1, 12):02}-2025", f"{day} Mar 2025", f"2025-{r.randint(1, 12):02}-{day}"]), "REF": lambda: f"{r.randrange(10**12):012}", "VPA": lambda: f"{word()}@{word()[:4]}"}
                text, spans = "", []
                for part in re.split(r"(\{[A-Z_]+\})", template):
                    if part[:1] == "{":
                        value, label = slots[part[1:-1]](), part[1:-1]
                        if kind != "none" and label != "BANK":
                            spans.append({"start": len(text), "end": len(text) + len(value), "label": label})
                        part = value
                    text += part
                rows.append((f"syn-{seed}-{i}", text, kind, channel, f"t{k}", spans))
            yield pd.DataFrame(rows, columns=["id", "text", "kind", "channel", "template_id", "spans"])

    return spark.range(n).mapInPandas(make, schema)
