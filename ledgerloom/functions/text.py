"""Text columns: keys, tokens, masks and clean forms."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a bank is called in a statement's head, first hit wins.
BANK_NAMES = (
    ("state bank|sbi", "SBI"), ("icici", "ICICI"), ("axis", "Axis"), ("kotak", "Kotak"), ("hdfc", "HDFC"), ("idfc", "IDFC First"), ("punjab national|pnb", "PNB"), ("bank of baroda", "Bank of Baroda"),
    ("canara", "Canara"), ("yes bank", "Yes Bank"), ("federal", "Federal"), ("indusind", "IndusInd"), ("union bank", "Union Bank"), ("idbi", "IDBI"),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _kept(text: Column, keep: str) -> Column:
    """Runs of the kept characters, in lower case."""
    parts = F.split(F.regexp_replace(F.lower(_text(text)), f"[^{keep}]", " "), " ")
    return F.filter(parts, lambda x: x != "")


def merchant_key(merchant: Column) -> Column:
    """The first three runs of letters."""
    return F.array_join(F.slice(_kept(merchant, r"\p{L}"), 1, 3), " ")


def narration_norm(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(_text(text)), r"(?U)\s+", " "))


def merge_tokens(text: Column) -> Column:
    """The set of runs of letters, digits and marks."""
    return F.array_distinct(_kept(text, r"\p{L}\p{N}\p{M}"))


def match_tokens(text: Column) -> Column:
    """The set of runs of ASCII letters and digits."""
    return F.array_distinct(_kept(text, "a-z0-9"))


def shape_mask(text: Column) -> Column:
    """Digits as N, ASCII letters as A."""
    return F.regexp_replace(F.regexp_replace(text, "[a-zA-Z]", "A"), "[0-9]", "N")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def bank_name(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in BANK_NAMES:
        out = out.when(low.rlike(pattern), name)
    return out


def _entities(s: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        n = int(m[2], 16 if m[1] else 10)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return s.map(lambda t: re.sub(r"&#(x?)([0-9a-fA-F]+);", lambda m: one(m) if m[1] or m[2].isdecimal() else m[0], t), na_action="ignore")


def html_plain(text: Column) -> Column:
    """The text of a mail that looks like HTML; other text as it is. Numeric entities go through Arrow, only where there are any."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield _entities(s)

    s = F.regexp_replace(text, r"(?is)<(style|script|head)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    s = F.when(s.rlike("&#x?[0-9a-fA-F]+;"), F.pandas_udf(decode, "string")(s)).otherwise(s)
    for entity in ("nbsp", "lt", "gt", "quot", "apos", "amp"):
        char = " " if entity == "nbsp" else html.unescape(f"&{entity};")
        s = F.regexp_replace(s, f"(?i)&{entity};", char)
    plain = F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(text.rlike(r"(?i)<(html|head|body|div|table|tr|td|p|br|span|font)\b"), plain).otherwise(text)


def sender_key(sender: Column) -> Column:
    """A sender without its route prefix."""
    return F.regexp_replace(F.lower(sender), "^[a-z]{2}-", "")


def skeleton(text: Column) -> Column:
    """Digits as 0, capitalized words as W, the first eight words."""
    s = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"\b[A-Z][A-Za-z]+\b", "W")
    return F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda x: x != ""), 1, 8), " ")


def plain_symbols(text: Column) -> Column:
    """Same-length stand-ins for signs a vocabulary lacks."""
    return F.translate(text, "₹•", "$*")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_name(name: Column) -> Column:
    """Single spaces, no punctuation at the edges, no title."""
    s = F.btrim(F.regexp_replace(name, r"\s+", " "))
    s = F.regexp_replace(s, r"^[\s.,:;*'\"\-]+|[\s.,:;*'\"\-]+$", "")
    return F.regexp_replace(s, r"(?i)^(?:mr|mrs|ms|miss|dr|shri|smt)\.?\s+", "")


def head(text: Column, n: int = 60) -> Column:
    return F.substring(text, 1, n)


def without_lead(text: Column, leads: tuple[str, ...] = ("Paid to", "Received from", "Money sent to", "Sent to")) -> Column:
    return F.regexp_replace(text, "(?i)^(?:" + "|".join(leads) + r")\s+", "")


def chunks(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters, cut at line ends; a longer line is a piece of its own parts."""
    out, held = [], ""
    for line in text.split("\n"):
        while len(line) > size:
            if held:
                out.append(held)
                held = ""
            out.append(line[:size])
            line = line[size:]
        if held and len(held) + 1 + len(line) > size:
            out.append(held)
            held = line
        else:
            held = f"{held}\n{line}" if held else line
    return [*out, held] if held else out
