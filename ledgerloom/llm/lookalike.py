"""Visually identical text with different characters, brought to one consistent form.

Texts are exploded to positioned code points (a run of printable ASCII that no mark follows stays
one piece, since it is its own form), broadcast-joined with the decomposition and look-alike
mapping, cut into clusters of a base and its marks, marks ordered by their class, clusters
recomposed by a second broadcast join, and the strings rebuilt in order.

The form: canonical decomposition, full-width, half-width and no-break variants to their plain
characters, every kind of space to a space, characters that show nothing dropped, look-alike
letters of Greek and Cyrillic to Latin, marks in canonical order, recomposed. Case, punctuation,
digits and missing accents stay visible; line breaks and tabs stay.

Defined cases: a null text has a null form; an empty text is its own form; equal texts are worked
on once, however many rows hold them; any number of rows may share an id. Both mappings come from the
Unicode database by rule, so their size is bounded by Unicode itself (under 20,000 rows each).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "α": "a", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    "ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
}

_PLAIN = r"\t\n\r\x20-\x7E"
_PIECES = rf"[{_PLAIN}]+(?![^{_PLAIN}])|(?s:.)"
_VARIANT_TAGS = ("<wide>", "<narrow>", "<noBreak>")
#: Letters and marks that show nothing though their category says otherwise.
_BLANKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _plain(c: str) -> str:
    """One character without its full-width, half-width or no-break nature."""
    while (d := unicodedata.decomposition(c)).startswith(_VARIANT_TAGS):
        c = "".join(chr(int(x, 16)) for x in d.split()[1:])
        if len(c) != 1:
            break
    return c


def _form_of(cp: int) -> str:
    c = chr(cp)
    kind = unicodedata.category(c)
    if c in "\t\n\r":
        return c
    if kind in ("Cf", "Cc") or cp in _BLANKS:
        return ""
    if kind == "Zs":
        return " "
    return "".join(LOOKALIKES.get(x, x) for y in unicodedata.normalize("NFD", _plain(c)) for x in _plain(y)).replace("‐", "-")


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that may be the later part of a composed one."""
    tails: set[str] = set()
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        d = unicodedata.normalize("NFD", chr(cp))
        tails.update(d[1:])
    return frozenset(tails)


@lru_cache(1)
def mappings() -> tuple[pd.DataFrame, pd.DataFrame]:
    """(piece, out as array of {c, joins, class}) for code points that change or join, and (cluster, composed)."""
    joins = _joining()
    unit = lambda c: {"c": c, "joins": c in joins or unicodedata.combining(c) > 0, "cls": unicodedata.combining(c)}
    pieces, composed = [], {}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or unicodedata.category(chr(cp)) in ("Cn", "Co"):
            continue
        c, form = chr(cp), _form_of(cp)
        if form != c or unit(c)["joins"]:
            pieces.append((c, [unit(x) for x in form]))
        nfd = unicodedata.normalize("NFD", c)
        if len(nfd) > 1 and unicodedata.normalize("NFC", c) == c:
            composed["".join(LOOKALIKES.get(x, x) for x in nfd)] = "".join(LOOKALIKES.get(x, x) for x in c)
    # a Latin letter wins over a look-alike with the same parts
    for key in list(composed):
        composed[key] = unicodedata.normalize("NFC", key)
    return pd.DataFrame(pieces, columns=["piece", "out"]), pd.DataFrame(sorted(composed.items()), columns=["cluster", "composed"])


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    pieces, composed = mappings()
    out = "piece string, out array<struct<c: string, joins: boolean, cls: int>>"
    return spark.createDataFrame(list(pieces.itertuples(index=False, name=None)), out), spark.createDataFrame(composed, "cluster string, composed string")


def is_plain(text: Column) -> Column:
    """Whether a text is its own form at sight: printable ASCII, tabs and line breaks."""
    return ~text.rlike(f"[^{_PLAIN}]")


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def consistent_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """text_key, form for each different text that is not plain at sight."""
    pieces, composed = _tables(texts.sparkSession)
    odd = texts.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull() & ~is_plain(F.col("_t")))
    odd = odd.withColumn("k", text_key(F.col("_t"))).groupBy("k").agg(F.any_value("_t").alias("_t"))
    units = odd.select("k", F.posexplode(F.expr(f"regexp_extract_all(_t, r'{_PIECES}', 0)")).alias("pos", "piece"))
    alone = F.array(F.struct(F.col("piece").alias("c"), F.lit(False).alias("joins"), F.lit(0).alias("cls")))
    units = units.join(F.broadcast(pieces), "piece", "left").withColumn("out", F.coalesce("out", alone))
    units = units.select("k", "pos", F.posexplode("out").alias("sub", "u")).select("k", "pos", "sub", "u.*")
    order = Window.partitionBy("k").orderBy("pos", "sub")
    units = units.withColumn("seg", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    # marks by class, in their order within a class; the base has class 0 and comes first
    marks = F.array_sort(F.collect_list(F.struct((F.col("joins")).alias("joins"), "cls", "pos", "sub", "c")))
    clusters = units.groupBy("k", "seg").agg(marks.alias("m")).withColumn("cluster", F.array_join(F.col("m.c"), ""))
    plain = F.size("m") == 1
    whole = composed.select(F.col("cluster").alias("_c"), F.col("composed").alias("whole"))
    pair = composed.select(F.col("cluster").alias("_p"), F.col("composed").alias("pair"))
    clusters = clusters.join(F.broadcast(whole), F.when(~plain, F.col("cluster")) == F.col("_c"), "left")
    first_two = F.when(~plain & F.col("whole").isNull(), F.concat(F.get("m", F.lit(0))["c"], F.get("m", F.lit(1))["c"]))
    clusters = clusters.join(F.broadcast(pair), first_two == F.col("_p"), "left")
    rest = F.array_join(F.slice(F.col("m.c"), F.lit(3), F.greatest(F.size("m") - 2, F.lit(0))), "")
    done = F.coalesce("whole", F.concat("pair", rest), F.col("cluster"))
    built = clusters.select("k", "seg", done.alias("s")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seg", "s"))).alias("parts"))
    # a text of nothing but invisible characters has an empty form
    return odd.select("k").join(built, "k", "left").select(F.col("k").alias("text_key"), F.coalesce(F.array_join(F.col("parts.s"), ""), F.lit("")).alias("form"))


def forms(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, form for each row."""
    keyed = docs.select(F.col(row_id), F.col(text).alias("_t"), text_key(F.col(text)).alias("text_key"))
    done = consistent_texts(docs, text)
    return keyed.join(done, "text_key", "left").select(row_id, F.coalesce("form", "_t").alias("form"))


def form_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, form_key for each different text."""
    plain = docs.where(is_plain(F.col(text))).select(text_key(F.col(text)).alias("text_key")).distinct().withColumn("form_key", F.col("text_key"))
    odd = consistent_texts(docs, text).select("text_key", text_key(F.col("form")).alias("form_key"))
    return plain.unionByName(odd)


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, class_id (smallest id of the form), n_texts (different texts of the form), n_rows."""
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(row_id), text_key(F.col(text)).alias("text_key")).join(stored(form_keys(docs, text), "form-keys"), "text_key")
    per = keyed.groupBy("form_key", "text_key").agg(F.min(row_id).alias("_id"), F.count("*").alias("_n")).groupBy("form_key").agg(F.min("_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("_n").alias("n_rows"))
    return keyed.join(per, "form_key").select(row_id, "class_id", "n_texts", "n_rows")


def lookalike_pairs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_a, doc_b: rows whose texts differ and have one form.

    Texts are paired first and only then joined with their rows, so copies of one text meet no copy of themselves.
    """
    keys = stored(form_keys(docs, text), "form-keys")  # three branches read them
    several = keys.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").select("form_key")
    texts = keys.join(several, "form_key", "left_semi")
    pairs = texts.withColumnRenamed("text_key", "ka").join(texts.withColumnRenamed("text_key", "kb"), "form_key").where("ka <> kb").select("ka", "kb")
    rows = docs.select(F.col(row_id).alias("id"), text_key(F.col(text)).alias("k")).where("id is not null and k is not null").distinct()
    out = pairs.join(rows.select(F.col("id").alias("doc_a"), F.col("k").alias("ka")), "ka").join(rows.select(F.col("id").alias("doc_b"), F.col("k").alias("kb")), "kb")
    return out.where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
