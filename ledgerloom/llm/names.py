"""Variant spellings of names typed by people: pigeonhole segment joins over the words and the whole of each name.

A name becomes a form: its words in lower case without titles, linking words and legal endings. A form is read as a
stem (a rare word of the table: a surname or a firm's own word) and a rest (given names, trade). Stems of one book are joined by
edit distance with the segment join of ``segments``: k + 1 segments, an inverted index by (length, place, segment), probes at the
positions k edits can shift a segment to, banded edit distance. Forms with joined stems are one payee if their rests fit word by word:

* equal, or standing for one given name in ``nicknames`` (an input table; a default comes with the module),
* within the allowed edits, unless both words are given names of the table or both are common in the data and neither is far more common
  than the other (so a misspelling is rare against its word, at any size of the data),
* shortened: an initial, a start, a skeleton of consonants, a start with another vowel at the end; or trailing words left out.

Shortened forms join the one fuller entity that fits them best, and none if several fit equally (relatives with one initial). A form
of one word is also cut in two at the stems of its book, and joined with the whole letters of all other forms by edit distance.
Components of the links are the entities. No name, trade or ending decides what is compared: words are weighed by the counts of this table.

Defined cases: null and empty names have no links; a name without letters is linked to nothing; names
are compared within their book only, a null book being one of its own; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.segments import components, edit_join, pairs_within, segment_join
from ledgerloom.session import forget, release, stored

#: Given names and their short forms (default of ``nicknames``). A name without short forms is a name of its own.
NICKNAMES = {
    # India
    "abhishek": "abhi", "aditya": "adi", "ajay": "", "akash": "", "amit": "", "amitabh": "", "anand": "", "anil": "", "anita": "anu", "anjali": "anju", "arjun": "", "aruna": "", "ashok": "", "asha": "", "balakrishna": "bala balu",
    "bharat": "", "bhavana": "", "chandrika": "chandu", "deepak": "", "deepika": "deepa deepu", "devendra": "dev", "dinesh": "", "farhana": "faru", "fatima": "", "ganesh": "", "gayatri": "gayu", "geeta": "", "gopal": "",
    "harish": "", "harshvardhan": "harsh", "imran": "", "indrajit": "indu", "indira": "", "jayalakshmi": "jaya", "jyoti": "", "kalpana": "", "karthik": "", "kavita": "", "kiran": "", "kirtana": "kirti", "krishna": "", "krishnan": "krish",
    "kumar": "", "lakshmi": "lachu", "lalita": "", "madhav": "", "madhuri": "madhu", "mahesh": "", "manjunath": "manju", "manoj": "", "meena": "", "meenakshi": "meena meenu", "mohan": "", "mohammed": "", "mukesh": "", "naresh": "",
    "naveen": "", "neha": "", "nikhil": "nik", "nitin": "", "omprakash": "omi", "padma": "", "pooja": "", "pradeep": "", "prakash": "", "pramod": "", "prasad": "", "praveen": "", "priyanka": "priya", "pushpavati": "pushpa",
    "rahul": "", "rajendra": "raju", "rajesh": "raj raju", "rakesh": "", "ramesh": "", "ravi": "", "ravindra": "ravi", "rekha": "", "ritu": "", "rohit": "", "sandeep": "", "sandhya": "", "sanjay": "sanju", "santosh": "", "sarita": "",
    "seema": "", "shankar": "", "shanti": "", "shyam": "", "siddharth": "sid", "sita": "", "subramani": "subbu", "sunil": "", "sunita": "", "suresh": "", "swati": "", "uma": "", "usha": "", "vandana": "", "venkatesh": "venky",
    "vijay": "", "vikram": "vicky vik", "vinod": "", "vishal": "", "yogendra": "yogi", "zubeida": "zubi",
    # England and its like
    "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy cate kate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "edward": "ed eddie ted",
    "elizabeth": "liz beth betty eliza", "george": "", "henry": "harry hal", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "joseph": "joe joey", "margaret": "maggie meg peggy", "mary": "molly polly", "michael": "mike mick",
    "patricia": "pat patty", "peter": "pete", "richard": "dick rick", "robert": "bob rob bobby", "samuel": "sam", "susan": "sue susie", "thomas": "tom tommy", "victoria": "vicky", "william": "bill will billy",
}
#: Titles, linking words and legal endings of names.
TITLES = frozenset("mr mrs ms miss mx dr prof shri sri smt kumari".split())
LINKING = frozenset("and nd n".split())
ENDINGS = frozenset("limited ltd private pvt p llp inc plc corp sons sns company co brothers bros brs".split())
LONG_ENDINGS = ("limited", "private", "company", "brothers", "incorporated", "corporation")

#: A word may be a stem if it is at most so many times as frequent as the rarest word of its name.
STEM_RATIO = 10
#: Two words that both occur so often, and in so large a share of all words, are different words unless one is ``TYPO_RATIO`` times as frequent.
SEEN_OFTEN, SEEN_SHARE, TYPO_RATIO = 5, 1 / 2000, 10


def osa(a: str, b: str, most: int) -> int:
    """Edit distance that counts a swap of neighbours as one edit; most + 1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, prev = prev, now
        if min(now) > most:
            return most + 1
    return prev[-1]


@lru_cache(100_000)
def _is_ending(word: str) -> bool:
    return word in ENDINGS or len(word) >= 5 and any(osa(word, w, 1) <= 1 for w in LONG_ENDINGS)


def form_of(name: str | None) -> tuple[list[str], list[str]]:
    """The words of a name's form, and its letters run together as they may be written (with and without linking words, first word last)."""
    if not name:
        return [], []
    s = unicodedata.normalize("NFKC", name)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s).lower().replace("&", " and ")
    words = re.findall(r"[^\W\d_]+", s)
    if not words:
        return [], []
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    core = [w for w in words if w not in LINKING] if len(words) > 2 else list(words)
    if len(core) < 2:
        core = list(words)
    while len(core) > 2 and (_is_ending(core[-1]) or core[-1] in ("a", "an") and len(core) < len(words)):
        core.pop()
    if len(core) == 1:
        # endings run together with the rest
        for tail in ("andsons", "andcompany", "andco", "brothers", "privatelimited", "limited"):
            if core[0].endswith(tail) and len(core[0]) >= len(tail) + 6:
                core = [core[0][: -len(tail)]]
    # a linking word cut off at the end of a longer name says nothing
    if len(core) > 2 and core[-1] in ("a", "an"):
        core.pop()
    linked = words[: words.index(core[-1]) + 1] if core and core[-1] in words else core
    glued = {"".join(x) for way in (core, linked) for x in (way, way[1:] + way[:1])}
    return core, sorted(glued)


def forms(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with words and glued."""

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            parsed = [form_of(n) for n in s]
            yield pd.DataFrame({"words": [w for w, _ in parsed], "glued": [g for _, g in parsed]})

    out = F.pandas_udf(parse, "words array<string>, glued array<string>")
    return names.withColumn("_f", out(F.col(name))).select(*names.columns, "_f.words", "_f.glued")


def default_nicknames(df: DataFrame) -> DataFrame:
    """word, given: the module's table of names as a DataFrame."""
    rows = [(w, given) for given, short in NICKNAMES.items() for w in {given, *short.split()}]
    return df.sparkSession.createDataFrame(rows, "word string, given string")


Word = tuple[str, int, frozenset]


@lru_cache(200_000)
def _word(coded: str) -> Word:
    """A word, its count (0 if it isn't common) and the given names it stands for."""
    w, n, given = coded.split(":")
    return w, int(n), frozenset(given.split("|")) if given else frozenset()


def _rivals(a: Word, b: Word) -> bool:
    """Whether two unequal words are both so common that neither is the other misspelt."""
    few, many = sorted((a[1], b[1]))
    return few > 0 and many < TYPO_RATIO * few


_VOWELS = frozenset("aeiouy")


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(500_000)
def word_fit(x: str, y: str) -> tuple[int, int, bool] | None:
    """How far two words are apart (cost, edits), and whether neither shortens the other; None if they are different words."""
    a, b = _word(x), _word(y)
    if a[0] == b[0]:
        return 0, 0, True
    if a[2] & b[2]:
        return 0, 0, a[2] == b[2]  # a short form of several names joins one of them only
    short, long = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    s, t = short[0], long[0]
    if len(s) == 1:
        return (1, 0, False) if t[0] == s or any(g[0] == s for g in long[2]) else None
    if a[2] and b[2]:
        return None  # two given names
    most = 2 if len(s) >= 7 else 1 if len(s) >= 4 else 0
    if most and not _rivals(a, b) and (d := osa(s, t, most)) <= most:
        return d, d, True
    if t.startswith(s):
        return 1, 0, False
    full = t[:-3] + "y" if t.endswith("ies") else t
    if s[0] == t[0] and sum(c in _VOWELS for c in s[1:]) <= max(1, len(s) // 4) and (_within(s, t) or _within(s, full)):
        return 2, 0, False
    if len(s) >= 4 and s[-1] in _VOWELS and t.startswith(s[:-1]):
        return 2, 0, False
    if len(s) >= 4 and osa(s, t[: len(s)], 1) <= 1:
        return 4, 1, False
    return None


@lru_cache(500_000)
def rest_fit(x: str, y: str) -> tuple[int, int, int] | None:
    """(cost, edits, way) of two rests: way 0 if they are the same words, 1 if the first is the shortened one, 2 if the second is."""
    a, b = x.split(), y.split()
    if not a or not b:
        return (0, 0, 0) if not a and not b else None
    cost = edits = 0
    same = len(a) == len(b)
    for v, w in zip(a, b):
        if (fit := word_fit(v, w)) is None:
            return None
        cost, edits, same = cost + fit[0], edits + fit[1], same and fit[2]
    if same:
        return cost, edits, 0
    letters = lambda ws: sum(len(w.split(":", 1)[0]) for w in ws)
    way = 1 if (len(a), letters(a)) < (len(b), letters(b)) else 2
    return cost + 2 * abs(len(a) - len(b)), edits, way


def _fit_column(*columns: str) -> Column:
    """code: cost * 4 + way + 1 of two readings, 0 if they are different payees."""

    def one(sx: str, rx: str, sy: str, ry: str) -> int:
        both = 0
        if sx != sy:
            stem = word_fit(sx, sy)
            if stem is None or not stem[2]:
                return 0
            both = stem[1]
        fit = rest_fit(rx, ry)
        if fit is None or both and fit[1] and both + fit[1] > 2:
            return 0
        return (fit[0] + both) * 4 + fit[2] + 1

    def fit(a: pd.Series, ra: pd.Series, b: pd.Series, rb: pd.Series) -> pd.Series:
        return pd.Series([one(*z) for z in zip(a, ra, b, rb)], dtype="int32")

    return F.pandas_udf(fit, "int")(*columns)


def _readings(parsed: DataFrame, nicknames: DataFrame, used: list[DataFrame]) -> DataFrame:
    """book_id, form, s, stem, rest, letters, rare, initials: each form under each of its words; words carry their counts and given names.

    ``rare`` words of a form are its stems. ``initials`` tells that its rest is initials only.
    """
    several = parsed.select("book_id", "form", "words").distinct()
    each = several.select("book_id", "form", F.posexplode("words").alias("pos", "w"))
    counts = each.groupBy("w").agg(F.count("*").alias("n"))
    given = nicknames.groupBy(F.col("word").alias("w")).agg(F.concat_ws("|", F.array_sort(F.collect_set("given"))).alias("given"))
    weighed = stored(counts.join(given, "w", "left").select("w", "n", F.coalesce("given", F.lit("")).alias("given")), "words")
    every_word = weighed.agg(F.sum("n")).first()[0] or 0
    common = F.when(F.col("n") >= F.lit(max(SEEN_OFTEN, every_word * SEEN_SHARE)), F.col("n")).otherwise(0)
    coded = F.concat_ws(":", "w", common.cast("string"), "given")
    told = each.join(weighed, "w").select("book_id", "form", F.struct("pos", "w", "n", "given", coded.alias("coded")).alias("x"))
    told = told.groupBy("book_id", "form").agg(F.array_sort(F.collect_list("x")).alias("x"))
    long = F.filter("x", lambda x: F.length(x["w"]) > 1)
    rare = F.array_min(F.transform(long, lambda x: x["n"]))
    # of a form of one word it is the stem, with an empty rest
    every = told.select("book_id", "form", "x", rare.alias("rare"), F.explode(long).alias("_s"))
    cols = ["book_id", "form", F.col("_s.w").alias("s"), F.col("_s.coded").alias("stem"), F.filter("x", lambda x: x["pos"] != F.col("_s.pos")).alias("r"), (F.col("_s.n") <= F.col("rare") * STEM_RATIO).alias("rare")]
    whole = stored(every.select(*cols), "readings")

    # a form of one word, cut where a stem of its book begins or ends
    single = parsed.where("size(words) = 1").select("book_id", "form").distinct().where("length(form) >= 6")
    cuts = single.select("book_id", "form", F.explode(F.sequence(F.lit(3), F.length("form") - 2)).alias("at"))
    cuts = cuts.unionByName(cuts.withColumn("at", -F.col("at")))
    head = F.expr("if(at > 0, substring(form, 1, at), substring(form, length(form) + at + 1))")
    tail = F.expr("if(at > 0, substring(form, at + 1), substring(form, 1, length(form) + at))")
    known = whole.where("rare and size(r) > 0").select(F.col("book_id").alias("_b"), "s", "stem").distinct()
    cut = cuts.select("book_id", "form", head.alias("s"), tail.alias("w")).hint("merge").join(known, "s").where(F.col("book_id").eqNullSafe(F.col("_b"))).drop("_b")
    cut = cut.join(weighed, "w", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("given", F.coalesce("given", F.lit("")))
    cut = cut.select("book_id", "form", "s", "stem", F.array(F.struct(F.lit(0).alias("pos"), "w", "n", "given", coded.alias("coded"))).alias("r"), F.lit(True).alias("rare"))
    out = whole.unionByName(cut)
    used += [weighed, whole]
    first = F.get("r", F.lit(0))
    # a rest meets another under a common letter: the first two of its first word (an edit can harm one of them) and those of the given names
    letters = F.concat(F.array(F.substring(first["w"], 1, 1), F.when(F.length(first["w"]) > 3, F.substring(first["w"], 2, 1))), F.transform(F.split(first["given"], r"\|"), lambda g: F.substring(g, 1, 1)))
    letters = F.when(F.size("r") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.filter(letters, lambda c: c.isNotNull() & (c != ""))))
    initials = (F.size("r") > 0) & F.forall("r", lambda x: F.length(x["w"]) == 1)
    return out.select("book_id", "form", "s", "stem", F.array_join(F.col("r.coded"), " ").alias("rest"), letters.alias("letters"), "rare", initials.alias("initials"))


def _part(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored as a query of its own: what the driver holds of a query grows as its plan times its exchanges, and is let go after each part."""
    out = stored(df, label)
    release(df.sparkSession)
    return out


def entities(names: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """book_id, name, entity, n_links for each different name of a book; entity is null where nothing could be read.

    ``names`` has book_id and name; ``nicknames`` has word and given (a given name is a word of its own). n_links counts the other spellings of the entity.
    """
    every = names.select("book_id", "name").where("name is not null and name <> ''").distinct()
    parsed = stored(forms(every).withColumn("form", F.array_join("words", " ")), "forms")
    used: list[DataFrame] = []
    read = _part(_readings(parsed.where("form <> ''"), default_nicknames(names) if nicknames is None else nicknames, used), "readings")
    forget(*used)
    node = lambda form: F.concat_ws("\u001f", F.coalesce(F.col("book_id").cast("string"), F.lit("\u0000")), F.col(form))

    stems = _part(edit_join(read.where("rare").select("book_id", "s"), ["book_id"], "s", swaps=True), "stems")
    placed = read.withColumn("node", node("form"))
    side = lambda p: placed.select(*(F.col(c).alias(p + c) for c in ("book_id", "node", "s", "stem", "rest", "letters", "rare", "initials")), F.explode("letters").alias("letter"))
    a, b = (side(p).withColumnRenamed("letter", f"{p}letter") for p in ("a_", "b_"))
    once = F.array_min(F.array_intersect("a_letters", "b_letters")) == F.col("a_letter")
    met = (F.col("a_letter") == F.col("b_letter")) & F.col("a_book_id").eqNullSafe(F.col("b_book_id"))
    cols = ["a_node", "a_stem", "a_rest", "b_node", "b_stem", "b_rest"]
    # stems meet their like; initials also meet a full name whose rarer word is another one
    pair = F.col("a_rare") & F.col("b_rare") & (F.col("a_node") < F.col("b_node")) | F.col("a_initials") & ~F.col("b_rare")
    own = a.where("a_rare").join(b, met & (F.col("a_s") == F.col("b_s"))).where(once & pair).select(*cols)
    near = stems.select(F.col("book_id").alias("_b"), F.col("key_a").alias("_s"), F.col("key_b").alias("_t"))
    widened = a.where("a_rare").join(near, (F.col("a_s") == F.col("_s")) & F.col("a_book_id").eqNullSafe(F.col("_b"))).drop("_b", "_s")
    other = widened.join(b.where("b_rare"), met & (F.col("_t") == F.col("b_s"))).where(once & (F.col("a_node") != F.col("b_node"))).select(*cols)
    # whole forms, their words in order of the alphabet, for names whose words are all common or the rarest of which is misspelt
    sheets = placed.where("form like '% %' and not initials").groupBy("book_id", "node").agg(F.array_sort(F.collect_set("stem")).alias("ws")).where("size(ws) > 1")
    sheets = stored(sheets.select("book_id", "node", F.array_join(F.transform("ws", lambda x: F.substring_index(x, ":", 1)), "").alias("s"), F.array_join("ws", " ").alias("rest")), "sheets")
    sheet = lambda p: sheets.select(F.col("book_id").alias("_b"), F.col("s").alias(f"key_{p}"), F.col("node").alias(f"{p}_node"), F.lit("").alias(f"{p}_stem"), F.col("rest").alias(f"{p}_rest"))
    typed = near_sheets = stored(edit_join(sheets, ["book_id"], "s"), "typed")
    for p in "ab":
        typed = typed.join(sheet(p), f"key_{p}").where(F.col("book_id").eqNullSafe(F.col("_b"))).drop("_b")
    fitted = lambda pairs: pairs.withColumn("code", _fit_column("a_stem", "a_rest", "b_stem", "b_rest")).where("code > 0").select("a_node", "b_node", F.expr("code div 4").cast("int").alias("cost"), (F.col("code") % 4 - 1).alias("way"))
    parts = [_part(fitted(x), "fits") for x in (own, other, typed.select(*cols))]
    forget(stems, sheets, near_sheets)

    # forms of one word against all letters of the other forms of the book
    glued = stored(parsed.where("form <> ''").select("book_id", "form", F.size("words").alias("n"), F.explode("glued").alias("s")).distinct(), "glued")
    single = glued.where("n = 1 and length(s) >= 6").select("book_id", "s").distinct()
    close = segment_join(glued.where("n > 1").select("book_id", "s").distinct(), single, ["book_id"])
    equal = single.select("book_id", F.col("s").alias("a"), F.col("s").alias("b"), F.lit(0).alias("d"))
    owner = glued.where("n > 1").select(F.col("book_id").alias("_b"), F.col("s").alias("a"), F.col("form").alias("_f"))
    whole = close.unionByName(equal).join(owner, "a").where(F.col("book_id").eqNullSafe(F.col("_b")))
    whole = whole.select(node("b").alias("a_node"), node("_f").alias("b_node"), F.col("d").cast("int").alias("cost"), F.lit(1).alias("way"))
    parts.append(_part(whole, "whole"))
    links = stored(reduce(DataFrame.unionByName, parts).where("a_node <> b_node"), "links")
    forget(glued, *parts)

    # the same words spelt otherwise are one entity; a shortened form joins the one entity that fits best
    solid = components(links.where("way = 0").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    label = lambda df, c: df.join(solid.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(c, F.coalesce(f"{c}_label", c)).drop(f"{c}_label")
    short = links.where("way > 0").select(F.expr("if(way = 1, a_node, b_node)").alias("short"), F.expr("if(way = 1, b_node, a_node)").alias("full"), "cost")
    short = label(label(short, "short"), "full").where("short <> full").groupBy("short", "full").agg(F.min("cost").alias("cost"))
    short = stored(short, "shortened")
    ends = short.select("full").distinct().join(short.select(F.col("short").alias("full")).distinct(), "full", "left_anti").withColumn("last", F.lit(0))
    ranked = short.join(ends, "full", "left").withColumn("rank", F.struct(F.coalesce("last", F.lit(1)).alias("open"), F.col("cost").alias("cost")))
    best = ranked.groupBy("short").agg(F.min("rank").alias("best"))
    chosen = ranked.join(best, "short").where("rank = best").groupBy("short").agg(F.min("full").alias("full"), F.count("*").alias("n")).where("n = 1")
    chosen = stored(chosen.select(F.col("short").alias("a"), F.col("full").alias("b")), "chosen")
    release(names.sparkSession)
    joined = components(chosen)

    out = parsed.select("book_id", "name", F.when(F.col("form") != "", node("form")).alias("node"))
    out = out.join(solid, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    out = stored(out.join(joined, "node", "left").select("book_id", "name", F.coalesce("label", "node").alias("entity")), "entities")
    forget(parsed, read, links, solid, short, chosen, joined)
    sizes = out.where("entity is not null").groupBy("entity").agg(F.count("*").alias("_n"))
    return out.join(sizes, "entity", "left").select("book_id", "name", "entity", (F.coalesce("_n", F.lit(1)) - 1).alias("n_links"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """book_id, name_a < name_b: all pairs of spellings of one entity."""
    many = linked.where("n_links > 0").withColumn("n", F.col("n_links") + 1)
    return pairs_within(many, ["entity"], "name", "n", ["book_id"]).select("book_id", F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def payee_names(transactions: DataFrame, spend: DataFrame) -> DataFrame:
    """book_id, name of both tables."""
    return transactions.select("book_id", F.col("counterparty").alias("name")).unionByName(spend.select("book_id", F.col("merchant").alias("name")))
