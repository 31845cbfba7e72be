"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH, edit verification.

A window of ``window`` words is embedded by CGK random walks: a pointer moves through the words by coin flips that depend on the word
and the step, and the words it stands on are written down, so that edit distance becomes Hamming distance. A signature samples a run of
places of one walk's output; a place in a document that shares a signature with an item window is a candidate, and candidates are verified by
word edit distance. Equal windows share every signature, so passages held word for word are always found; for passages within ``max_edits`` the
number of walks is worked out from ``target_recall`` by simulating every mixture of edits on windows of random words (``plan``).

Documents are read once, whatever the number of items: a Bloom filter of the item signatures (of ``max_bits`` bits at most) drops the places that
cannot match, all others are joined with the item signatures by equality, so a filter that is too full costs time and loses nothing. Documents'
words become numbers in the JVM and pass through numpy without a Python step per word.

The least passage that counts is the symbol of the search: windows are ``window`` words of an item rather than the whole of it, since parts of items must
be found, and a document passage may be up to ``max_edits`` words shorter or longer.

Defined cases: null texts and texts shorter than a window (less the edits) have no leak; an item shorter than a window cannot leak; repeated items
count under each of their ids, null ids not at all; repeated documents come out under their ids once; texts of any length are
worked off in pieces that overlap; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored


@dataclass(frozen=True)
class LeakConfig:
    """window: words of a passage. max_edits: word edits allowed in it. target_recall: least recall for each mixture of that many edits."""

    window: int = 12
    max_edits: int = 2
    target_recall: float = 0.95
    seed: int = 20240601
    max_bits: int = 1 << 28
    chunk: int = 200_000


EXACT = LeakConfig(max_edits=0)


def _walk(symbols: np.ndarray, starts: np.ndarray, coins: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """The words under the pointer of one walk, step by step; beyond the window it writes a blank (0)."""
    at = np.zeros(len(starts), np.int64)
    for coin in coins:
        seen = np.where(at < window, symbols[starts + np.minimum(at, window - 1)], np.uint64(0))
        yield seen
        at += ((seen * coin) >> np.uint64(63)).astype(np.int64)


class CGK:
    """Walks and sampled runs: ``walks`` rows of coins, and the first step of each run of ``run`` steps."""

    def __init__(self, window: int, walks: int, run: int, firsts: tuple[int, ...], seed: int):
        rng = np.random.default_rng(seed)
        self.window, self.walks, self.run, self.firsts = window, walks, run, firsts
        # coins of further walks don't change those of the first, so a plan grows without starting anew
        draw = [rng.integers(1, 2**63, (2, firsts[-1] + run), dtype=np.uint64) | np.uint64(1) for _ in range(walks)]
        self.coins, self.mix = [d[0] for d in draw], [d[1] for d in draw]

    def signatures(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each walk and run, its number and the signature of the window at each start."""
        for w in range(self.walks):
            sums = [np.full(len(starts), w * 64 + r, np.uint64) for r in range(len(self.firsts))]
            for j, seen in enumerate(_walk(symbols, starts, self.coins[w], self.window)):
                mixed = (seen ^ (seen >> np.uint64(29))) * self.mix[w][j]
                for r, first in enumerate(self.firsts):
                    if first <= j < first + self.run:
                        sums[r] = sums[r] + mixed
            for r, s in enumerate(sums):
                s = (s ^ (s >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                yield w * len(self.firsts) + r, s ^ (s >> np.uint64(29))


def edited(rng: np.random.Generator, window: int, kinds: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of random words, and the same with one edit of each of ``kinds`` (s, i, d) at different places; other words follow."""
    a, b = [], []
    for _ in range(n):
        x = rng.integers(1, 2**62, 2 * window).tolist()
        y = x[:window]
        for kind, p in zip(kinds, sorted(rng.choice(window, len(kinds), replace=False).tolist(), reverse=True)):
            y[p : p + (kind != "i")] = [] if kind == "d" else [int(rng.integers(1, 2**62))]
        a.append(x), b.append((y + rng.integers(1, 2**62, 2 * window).tolist())[: 2 * window])
    return np.array(a, np.uint64), np.array(b, np.uint64)


def recalls(cgk: CGK, mixtures: list[str], seed: int, n: int = 800) -> dict[str, float]:
    """The share of edited windows that share a signature with their originals, for each mixture of edits."""
    rng, out = np.random.default_rng(seed), {}
    for kinds in mixtures:
        a, b = edited(rng, cgk.window, kinds, n)
        starts = np.arange(n) * a.shape[1]
        hit = np.zeros(n, bool)
        for (_, s), (_, t) in zip(cgk.signatures(a.ravel(), starts), cgk.signatures(b.ravel(), starts)):
            hit |= s == t
        out[kinds or "none"] = float(hit.mean())
    return out


def mixtures(max_edits: int) -> list[str]:
    return ["".join(x) for n in range(1, max_edits + 1) for x in combinations_with_replacement("sdi", n)]


@lru_cache(8)
def plan(config: LeakConfig) -> CGK:
    """The fewest walks that reach the target recall for each mixture of edits.

    A walk passes half a word a step. Runs are as long as the longest stretch of words that the edits must leave unharmed takes,
    and stand evenly over the steps in which a pointer is inside the window.
    """
    c = config
    reach = 2 * c.window - 2
    if not c.max_edits:
        return CGK(c.window, 1, reach, (0,), c.seed)
    run = max(3, 2 * c.window // (c.max_edits + 1))
    firsts = tuple(dict.fromkeys(np.linspace(0, max(0, reach - run), 2 * c.max_edits).round().astype(int).tolist()))
    for walks in range(2, 65):
        cgk = CGK(c.window, walks, run, firsts, c.seed)
        if min(recalls(cgk, mixtures(c.max_edits), c.seed + 1).values()) >= c.target_recall:
            return cgk
    raise ValueError("no number of walks reaches the target recall for so many edits in so short a window")


def symbols(text: Column) -> Column:
    """The words of a text (runs of letters or digits, in lower case) as 64-bit numbers."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _flat(column: pa.ListArray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all lists with ``pad`` blanks before, between and behind them; first place and length of each list."""
    lengths = np.diff(column.offsets.to_numpy())
    first = pad + np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    flat = np.zeros(int(lengths.sum()) + pad * (len(lengths) + 1), np.uint64)
    values = column.flatten().to_numpy().view(np.uint64)
    # a word must not look like a blank
    flat[np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(values)) if len(lengths) else []] = np.where(values == 0, np.uint64(1), values)
    return flat, first.astype(np.int64), lengths


def _window_starts(first: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a window of ``least`` words at least begins, and the list each belongs to."""
    n = np.maximum(0, lengths - least + 1)
    owner = np.repeat(np.arange(len(n)), n)
    return np.repeat(first, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def _context(flat: np.ndarray, starts: np.ndarray, before: int, after: int) -> pa.Array:
    """The words from ``before`` places before each start to ``after`` places behind it."""
    block = flat[starts[:, None] + np.arange(-before, after)].view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(block.ravel()), before + after).cast(pa.list_(pa.int64()))


def _edits(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal shape: the least edits that turn a into a start of b, and the length of that start."""
    n, w = a.shape
    width = w + most
    prev = np.tile(np.arange(width + 1), (n, 1))
    for i in range(1, w + 1):
        now = np.empty_like(prev)
        now[:, 0] = i
        change = prev[:, :-1] + (b[:, :width] != a[:, i - 1 : i])
        np.minimum(change, prev[:, 1:] + 1, out=change)
        for j in range(1, width + 1):
            now[:, j] = np.minimum(change[:, j - 1], now[:, j - 1] + 1)
        prev = now
    tail = prev[:, w - most :]
    # of equal starts the one of the window's own length, then the shorter one
    rank = tail * 100 + np.abs(np.arange(w - most, width + 1) - w)
    best = rank.argmin(1)
    return tail[np.arange(n), best], best + w - most


_HIT = "doc_id bigint, item_id bigint, edits int, low int, high int"


def find_leaks(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, edits (of the best passage), leaked_words (words of the item inside matched passages)."""
    c, cgk = config, plan(config)
    # blanks enough for a window with its edits on both sides
    pad = c.window + c.max_edits
    before, after = pad, 2 * pad
    words = after + before

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first, lengths = _flat(batch.column("syms"), after)
            starts, owner = _window_starts(first, lengths, c.window)
            ids, place = batch.column("item_id").to_numpy(), starts - first[owner]
            context = _context(flat, starts, before, after)
            for t, sig in cgk.signatures(flat, starts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), t, np.int32)), pa.array(sig.view(np.int64)), pa.array(ids[owner]), pa.array(place.astype(np.int32)), context], ["t", "sig", "item_id", "place", "item_words"])

    asked = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().select("item_id", symbols(F.col("text")).alias("syms"))
    index = stored(asked.mapInArrow(item_windows, "t int, sig bigint, item_id bigint, place int, item_words array<bigint>"), "item-windows")
    bits = 1 << 16
    while bits < min(c.max_bits, 32 * index.count()):
        bits *= 2
    filled = docs.sparkSession.sparkContext.broadcast(_bloom(index, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = filled.value
        for batch in batches:
            for lo, part in _pieces(batch, c.chunk, pad):
                flat, first, lengths = _flat(part.column("syms"), after)
                starts, owner = _window_starts(first, lengths, c.window - c.max_edits)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for t, sig in cgk.signatures(flat, starts):
                    maybe = np.nonzero(_in_bloom(bloom, sig))[0]
                    if len(maybe):
                        context = _context(flat, starts[maybe], before, after)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(maybe), t, np.int32)), pa.array(sig[maybe].view(np.int64)), pa.array(ids[owner[maybe]]), context], ["t", "sig", "doc_id", "doc_words"])

    read = docs.where("doc_id is not null and text is not null").select("doc_id", symbols(F.col("text")).alias("syms")).where(F.size("syms") >= c.window - c.max_edits)
    found = read.mapInArrow(candidates, "t int, sig bigint, doc_id bigint, doc_words array<bigint>").join(index, ["t", "sig"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, i = (batch.column(x).flatten().to_numpy().reshape(-1, words) for x in ("doc_words", "item_words"))
            edits, length = _edits(i[:, before : before + c.window], d[:, before:], c.max_edits)
            near = edits <= c.max_edits
            # words that go on equal before and behind the passage have leaked too
            left = np.cumprod((d[:, before - 1 :: -1] == i[:, before - 1 :: -1]) & (i[:, before - 1 :: -1] != 0), 1).sum(1)
            after_doc = np.minimum(before + length[:, None] + np.arange(pad), words - 1)
            own = i[:, before + c.window : before + c.window + pad]
            right = np.cumprod((np.take_along_axis(d, after_doc, 1) == own) & (own != 0), 1).sum(1)
            place = batch.column("place").to_numpy()
            cols = [batch.column("doc_id").to_numpy(), batch.column("item_id").to_numpy(), edits.astype(np.int32), (place - left).astype(np.int32), (place + c.window + right).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in cols], ["doc_id", "item_id", "edits", "low", "high"])

    hits = found.mapInArrow(verify, _HIT)
    pairs = hits.groupBy("doc_id", "item_id", "low").agg(F.min("edits").alias("edits"), F.max("high").alias("high"))
    spans = pairs.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    joined = F.aggregate("spans", start, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(acc["upto"], x["low"]))).alias("n"), F.greatest(acc["upto"], x["high"]).alias("upto")))
    return spans.select("doc_id", "item_id", "edits", joined["n"].alias("leaked_words"))


def _pieces(batch: pa.RecordBatch, most: int, overlap: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch of about ``most`` words each; a longer text is cut in pieces that overlap, so each window with its context is in one of them."""
    lengths = np.diff(batch.column("syms").offsets.to_numpy())
    at = 0
    while at < len(lengths):
        if lengths[at] > most:
            row = batch.slice(at, 1)
            values, doc = row.column("syms").flatten(), row.column("doc_id")
            for lo in range(0, int(lengths[at]), most):
                part = values.slice(max(0, lo - overlap), most + 4 * overlap)
                yield lo, pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], ["doc_id", "syms"])
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most, "right")))
        long = np.nonzero(lengths[at:upto] > most)[0]
        upto = at + int(long[0]) if len(long) else upto
        yield 0, batch.slice(at, upto - at)
        at = upto


def _bloom_places(sig: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Four places of each signature in a filter of ``bits`` (a power of two)."""
    a, b = sig & np.uint64(0xFFFFFFFF), (sig >> np.uint64(32)) | np.uint64(1)
    for k in range(4):
        yield ((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64)


def _in_bloom(bloom: np.ndarray, sig: np.ndarray) -> np.ndarray:
    out = np.ones(len(sig), bool)
    for at in _bloom_places(sig, len(bloom) * 8):
        out &= (bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _bloom(index: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of all item signatures: one filter of bits / 8 bytes for each of at most eight tasks, united one by one."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in _bloom_places(batch.column("sig").to_numpy().view(np.uint64), bits):
                own[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["own"])

    out = np.zeros(bits // 8, np.uint8)
    for row in index.select("sig").coalesce(8).mapInArrow(fill, "own binary").toLocalIterator():
        out |= np.frombuffer(row["own"], np.uint8)
    return out
