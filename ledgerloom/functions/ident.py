"""Identity columns: content hashes, ids, references, account tails and handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.functions.text import merchant_key, narration_norm


#: Patterns of payment handles, account tails and references.
VPA = r"([a-z0-9][a-z0-9._-]{1,}@[a-z]{2,})(?![a-z0-9-])(?!\.[a-z])"
ACCOUNT_TAIL = r"(?:a/c|acct|account|ac)\s*(?:no\.?)?\s*[x*]*([0-9]{3,4})"
REFERENCE = "^(?:[0-9]{12}|[A-Za-z]{4}[A-Za-z0-9][0-9]{8,17}|[A-Za-z]{1,5}[0-9]{8,18})$"


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def content_hash(source: Column, ts: Column, paise: Column, direction: Column, reference: Column, narration: Column) -> Column:
    """By reference and direction where there is a reference, else by day, amount, direction and narration."""
    has_ref = F.coalesce(reference, F.lit("")) != ""
    by_ref = F.concat_ws("|", source, F.lit("ref"), reference, direction)
    by_row = F.concat_ws("|", source, cal.day_key(ts), paise.cast("string"), direction, narration_norm(narration))
    return _sha(F.when(has_ref, by_ref).otherwise(by_row))


def capture_hash(paise: Column, direction: Column, payee: Column, vpa: Column, ts: Column) -> Column:
    return _sha(F.concat_ws("|", paise.cast("string"), direction, merchant_key(payee), F.coalesce(vpa, F.lit("")), cal.day_key(ts)))


def insight_id(canonical: Column) -> Column:
    """16 hex digits of a card's canonical string."""
    return F.substring(_sha(canonical), 1, 16)


def hash_split(key: Column, parts: int) -> Column:
    """A part number in 0 … parts − 1 from the low byte of a digest; ``parts`` divides 256."""
    return (F.conv(F.right(F.sha1(key.cast("binary")), F.lit(2)), 16, 10).cast("int") % parts).cast("int")


def synthetic_reference(balance: Column, ts: Column, paise: Column) -> Column:
    return F.concat(F.lit("B"), balance.cast("string"), F.lit("D"), cal.compact_day(ts), F.lit("A"), paise.cast("string"))


def bare_reference(ref: Column) -> Column:
    """Without leading zeros; null if nothing is left."""
    return F.nullif(F.ltrim(ref, F.lit("0")), F.lit(""))


def vpa(text: Column) -> Column:
    """A payment handle: no dot after the sign."""
    return F.nullif(F.regexp_extract(F.lower(text), VPA, 1), F.lit(""))


def account_tail(text: Column) -> Column:
    """Three or four digits after an account word."""
    return F.nullif(F.regexp_extract(F.lower(text), ACCOUNT_TAIL, 1), F.lit(""))


def trailing_tail(text: Column) -> Column:
    """The last four digits at most of a run of three or more at the end."""
    run = F.regexp_extract(text, "([0-9]{3,})$", 1)
    return F.nullif(F.right(run, F.lit(4)), F.lit(""))


def is_reference(text: Column) -> Column:
    """12 digits, or a bank's code and digits, with eight digits at least."""
    return text.rlike(REFERENCE)
