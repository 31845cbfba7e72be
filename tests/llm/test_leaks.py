import random
import re

import numpy as np

from ledgerloom.llm import leaks

WORDS = [f"w{i}" for i in range(400)]
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def passages(seed, n_docs, edit):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 50)))) for i in range(25)]
    docs, truth = [], set()
    for d in range(n_docs):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            i, text = rng.choice([x for x in items if len(x[1].split()) >= 14])
            w = text.split()
            k = rng.randint(12, len(w))
            s = rng.randint(0, len(w) - k)
            piece = edit(rng, w[s : s + k])
            body[len(body) // 2 : len(body) // 2] = piece
            truth.add((d, i))
        docs.append((d, rng.choice([", ", " ", "\n- "]).join(x.upper() if rng.random() < 0.3 else x for x in body)))
    return docs, items, truth


def test_exact_passages_are_all_found(spark):
    docs, items, truth = passages(1, 300, lambda rng, w: w)
    docs += [(900, None), (901, ""), (902, "w1 w2"), (903, "x " * 300_000 + items[3][1])] + docs[:5]
    got = leaks.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([*items, (77, None), items[0]], ITEM)).where("edits = 0")
    found = [(r.doc_id, r.item_id) for r in got.collect()]
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert truth <= want and set(found) == want and len(found) == len(set(found))


def test_recall_with_edits(spark):
    def edit(rng, w):
        w = list(w)
        w[len(w) // 2] = "changed"
        return w

    docs, items, truth = passages(2, 300, edit)
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert len(truth & set(got)) >= 0.9 * len(truth) and all(e <= 2 for e in got.values())
    assert not set(got) - truth


def test_small_pieces_and_a_full_filter_give_the_same_result_and_empty_sides(spark):
    docs, items, _ = passages(3, 60, lambda rng, w: w)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    one = sorted(map(tuple, leaks.find_leaks(d, i).collect()))
    assert one == sorted(map(tuple, leaks.find_leaks(d, i, leaks.LeakConfig(max_bits=1 << 10, chunk=40)).collect())) and one
    assert leaks.find_leaks(d, i.limit(0)).count() == leaks.find_leaks(d.limit(0), i).count() == 0
    exact = {tuple(r)[:2] for r in leaks.find_leaks(d, i, leaks.EXACT).collect()}
    assert exact == {r[:2] for r in one if r[2] == 0}


def word_edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j - 1] + (x != y), prev[j] + 1, now[-1] + 1))
        prev = now
    return prev[-1]


def test_edits_of_a_passage():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 4, (300, 6)), rng.integers(1, 4, (300, 10))
    edits, length = leaks._edits(a, b, 2)
    for x, y, e, n in zip(a.tolist(), b.tolist(), edits, length):
        assert e == min(word_edits(x, y[:k]) for k in range(4, 9)) == word_edits(x, y[:n])


def test_planned_recall_is_reached_for_each_mixture_of_edits():
    cgk = leaks.plan(leaks.LeakConfig())
    got = leaks.recalls(cgk, leaks.mixtures(2), seed=99, n=1500)
    print(cgk.walks, "walks", got)
    assert len(got) == 9 and min(got.values()) >= 0.93
    assert leaks.plan(leaks.EXACT).walks == 1


def test_recall_of_windows_with_edits_against_brute_force(spark):
    """Items of exactly one window, 100 for each mixture of one or two edits at any place; and longer ones, whose leaked words are counted."""
    rng, kinds = random.Random(11), leaks.mixtures(2)
    items, docs, kind_of = [], [], {}
    for n in range(100 * len(kinds) + 200):
        kind = kinds[n % len(kinds)] if n < 100 * len(kinds) else "long"
        w = [f"v{rng.randrange(10**6)}" for _ in range(12 if kind != "long" else 16)]
        piece = list(w)
        for k, p in zip("ss" if kind == "long" else kind, sorted(rng.sample(range(12), 2), reverse=True)):
            piece[p : p + (k != "i")] = [] if k == "d" else [f"n{rng.randrange(10**6)}"]
        items.append((n, " ".join(w)))
        docs.append((n, " ".join([*(rng.choice(WORDS) for _ in range(9)), *piece, *(rng.choice(WORDS) for _ in range(n % 9))])))
        kind_of[n] = kind
    want = {}
    for (n, text), (_, body) in zip(items, docs):
        a, b = text.split(), body.split()
        for k in range(len(a) - 11):
            if any(word_edits(b[s : s + m], a[k : k + 12]) <= 2 for m in range(10, 15) for s in range(len(b) - m + 1)):
                want.setdefault(n, set()).update(range(k, k + 12))
    found = leaks.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    got = {r.doc_id: r.leaked_words for r in found}
    assert all(r.doc_id == r.item_id for r in found) and set(got) <= set(want)
    for kind in [*kinds, "long"]:
        mine = {n for n in want if kind_of[n] == kind}
        print(kind, len(mine), len(mine & set(got)) / len(mine))
        assert len(mine) >= 100 and len(mine & set(got)) >= 0.9 * len(mine)
    assert sum(got[n] == len(want[n]) for n in got) >= 0.97 * len(got)
