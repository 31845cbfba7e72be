"""Transaction alerts read by rule: direction, amount, handle, payee, account tail and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cal, dates, ident
from ledgerloom.functions.money import signed_paise
from ledgerloom.session import here

#: Words that tell the direction, words before and after a payee, and patterns of amounts.
DEBIT_WORDS = ("debited", "spent", "withdrawn", "paid", "sent", "purchase")
CREDIT_WORDS = ("credited", "received", "refund", "deposited")
DEBIT_LEADS = (" to vpa ", " vpa ", " to ", " at ", " towards ")
CREDIT_LEADS = (" from ", " by ")
STOP_WORDS = ("ref", "refno", "utr", "txn", "upi", "a/c", "acct", "account", "avl", "dated", "using", "thru", "through", "vide", "via")
STOP_BEFORE_NUMBER = ("on", "dt")
PAYEE_END = r"[.,|;:()!?*#]"
SIGNED_AMOUNT = r"(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
BARE_AMOUNT = r"(?<![0-9.])([0-9][0-9,]*\.[0-9]{2})(?![0-9.])"


def _any(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def direction(text: Column) -> Column:
    """debit or credit if the text has words of one side only."""
    low = F.lower(text)
    out, back = _any(low, DEBIT_WORDS), _any(low, CREDIT_WORDS)
    return F.when(out & ~back, "debit").when(back & ~out, "credit")


def _amount(text: Column) -> tuple[Column, Column]:
    """The first amount, and the text after it."""
    signed = F.regexp_extract(text, SIGNED_AMOUNT, 1)
    bare = F.regexp_extract(text, BARE_AMOUNT, 1)
    whole = F.when(signed != "", F.regexp_extract(text, SIGNED_AMOUNT, 0)).otherwise(F.regexp_extract(text, BARE_AMOUNT, 0))
    paise = signed_paise(F.when(signed != "", signed).otherwise(bare))
    # the bare form has a look-behind, so its place is that of its first occurrence after none of its signs
    at = F.when(signed != "", F.regexp_instr(text, F.lit(SIGNED_AMOUNT))).otherwise(F.regexp_instr(text, F.lit(BARE_AMOUNT)))
    return paise, F.substring(text, at + F.length(whole), F.length(text))


def _with_payee(x: DataFrame) -> DataFrame:
    """``x`` (direction, _rest) with _payee: the payee after the first lead word that gives one.

    Each step is a column of its own, so that no step is worked out twice.
    """
    low = F.col("_low")

    def tails(leads: tuple[str, ...]) -> Column:
        found = [F.when(F.instr(low, lead) > 0, F.substring("_rest", F.instr(low, lead) + len(lead), F.length("_rest"))) for lead in leads]
        return F.array_compact(F.array(*found))

    def kept(z: Column) -> Column:
        # up to a stop word, or one that stops before a number
        stop = F.transform(z["l"], lambda w, i: w.isin(*STOP_WORDS) | (w.isin(*STOP_BEFORE_NUMBER) & F.coalesce(F.get(z["l"], i + 1).rlike(r"^\p{N}"), F.lit(False))))
        return F.slice(z["w"], F.lit(1), F.coalesce(F.nullif(F.array_position(stop, F.lit(True)).cast("int"), F.lit(0)) - 1, F.size(z["w"])))

    x = x.withColumn("_low", F.lower("_rest"))
    x = x.withColumn("_tails", F.when(F.col("direction") == "credit", tails(CREDIT_LEADS)).otherwise(tails(DEBIT_LEADS)))
    x = x.withColumn("_words", F.transform("_tails", lambda t: F.filter(F.split(F.regexp_replace(t, f"(?s){PAYEE_END}.*$", ""), r"\s+"), lambda w: w != "")))
    x = x.withColumn("_lows", F.transform("_words", lambda ws: F.transform(ws, lambda w: F.lower(w))))
    x = x.withColumn("_both", F.arrays_zip(F.col("_words").alias("w"), F.col("_lows").alias("l")))
    x = x.withColumn("_kept", F.filter(F.transform("_both", kept), lambda ws: F.size(ws) > 0))
    return x.withColumn("_payee", F.array_join(F.get("_kept", F.lit(0)), " ")).drop("_low", "_tails", "_words", "_lows", "_both", "_kept")


def capture_time(day: Column, received: Column, minutes: Column) -> Column:
    """When an alert says it happened: its day and clock time, the arrival if it names no other day, else the start of its day."""
    midnight = cal.utc(day.cast("timestamp_ntz"))
    clock = midnight + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(day.isNull(), received).when(minutes.isNotNull(), clock).when(day == cal.day(received), received).otherwise(midnight)


def parse_alerts(alerts: DataFrame, text: str = "text", received: str = "received_at") -> DataFrame:
    """``alerts`` with direction, amount_paise, vpa, payee, account_tail, ts and capture_hash; only alerts that read as one payment stay.

    Defined cases: null or empty texts, texts with words of both directions or none, without a positive amount or without a payee are left out.
    """
    taken = {"direction", "amount_paise", "vpa", "payee", "account_tail", "ts", "capture_hash"}
    own = [c for c in alerts.columns if c in (text, received) or c.lower() not in taken]
    flat = F.btrim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    x = alerts.select(*own).withColumn("_t", flat).withColumn("direction", direction(F.col("_t")))
    paise, rest = _amount(F.col("_t"))
    x = x.withColumn("amount_paise", paise)
    x = _with_payee(x.withColumns({"_rest": rest, "vpa": ident.vpa(F.col("_t")), "account_tail": ident.account_tail(F.col("_t"))}))
    x = x.withColumn("payee", F.coalesce("_payee", F.split_part(F.col("vpa"), F.lit("@"), F.lit(1))))
    x = x.where(here(F.col("direction").isNotNull() & (F.col("amount_paise") > 0) & F.col("payee").isNotNull()))
    x = x.withColumns({"_day": dates.alert_day(F.col("_t")), "_minutes": dates.clock_minutes(F.col(text))})
    x = x.withColumn("ts", capture_time(F.col("_day"), F.col(received), F.col("_minutes")))
    return x.withColumn("capture_hash", ident.capture_hash(F.col("amount_paise"), F.col("direction"), F.col("payee"), F.col("vpa"), F.col("ts"))).drop("_t", "_rest", "_payee", "_day", "_minutes")


def ledger_rows(extracted: DataFrame) -> DataFrame:
    """Ledger rows of extracted alerts (is_txn, direction, amount_paise, ref, payee, vpa, cpty_acct_tail, ts) that name a reference."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    ok = F.col("is_txn") & F.col("direction").isNotNull() & (F.col("amount_paise") > 0) & blank("ref").isNotNull()
    party = F.coalesce(blank("payee"), blank("vpa"), F.concat(F.lit("A/c "), blank("cpty_acct_tail")), F.lit(""))
    return extracted.where(ok).select("ts", "amount_paise", "direction", party.alias("counterparty"), F.col("ref").alias("reference"), F.coalesce(blank("vpa"), F.lit("")).alias("narration"))
