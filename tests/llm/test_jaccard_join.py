"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from quillion.llm import jaccard_join

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, num, den):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append(set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                parent[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        t = top(x)
        if i is not None:
            least[t] = min(least.get(t, i), i)
    return sorted(((i, len(s), least.get(top(x))) for x, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, k, num, den, bits=64):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, cls int, root int")
    return sorted((tuple(r) for r in jaccard_join.join(docs, k=k, num=num, den=den, bits=bits).collect()), key=str)


def crowd(n, seed, words=120, edits=6):
    """Near copies on both sides of the threshold, all sharing most keys: heavy ones, and sets that need them."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(words)] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "num", "den", "bits", "shingles"), [(4, 85, 100, 64, 1 << 20), (5, 80, 100, 64, 1000), (4, 85, 100, 4, 1000)])
def test_against_brute_force(spark, monkeypatch, k, num, den, bits, shingles):
    """Also with blocks bounded by their shingles, and with classes that many different texts fall into."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(k)
    texts = crowd(90, 1) + crowd(40, 2, words=60, edits=3)
    shared = " ".join(f"p{i}" for i in range(40))
    texts += [shared + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    texts += [None, "", "  \n", "A b", "a B", "one two three", "One two three ", "x y z u v w", "x y z u v w"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "alone here with words"), (None, None)]
    assert run(spark, rows, k, num, den, bits) == brute(rows, k, num, den)


def test_empty_table(spark):
    assert run(spark, [], 4, 85, 100) == []


def test_long_text_without_links(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    near = long.replace("w15000 ", "x ")
    assert run(spark, [(1, long), (2, near), (3, "w1 w2 w3 w4")], 5, 80, 100) == [(1, 29996, 1), (2, 29996, 1), (3, 1, 3)]


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100)])
def test_linked_sets_near_a_band_edge_share_what_they_need(num, den):
    bands = jaccard_join.Bands(num, den)
    for edge in bands.upper[bands.upper < 400].tolist():
        for x in range(max(1, edge - 12), edge + 13):
            for y in range(x, x * den // num + 1):
                common = -(-num * (x + y) // (den + num))  # the fewest that link them
                if common > x:
                    continue
                of_x, of_y = bands.of(np.array([x, y]))
                assert of_y - of_x <= 1
                at = np.array([of_x, of_x])  # the smaller set's band, to which the larger reaches down
                need = bands.spare(np.array([x, y]), at).max() + 1
                assert bands.segments[of_x] + bands.zone[of_x] - (x + y - 2 * common) >= need, (x, y, common)


def test_a_key_is_dropped_where_that_costs_less():
    rnd = random.Random(5)
    groups = [[(rnd.randrange(40), rnd.randrange(2), rnd.randrange(2)) for _ in range(n)] for n in [1, 2, 3, 5, 9, 17, 40, 136, 137, 138, 200]]
    rows = [r for g in groups for r in g]
    info = np.array([spare | deletion << jaccard_join._DELETION | zone << jaccard_join._ZONE for spare, deletion, zone in rows], np.int64)
    size = np.array([len(g) for g in groups])
    start = np.cumsum(size) - size
    for cost, row in ((0, 1), (3, 2), (64, 4)):
        want = []
        for g in groups:
            without = sum(row + cost * min(1, (1 if deletion else 1 + zone) / (spare + 1)) for spare, deletion, zone in g)
            want.append(len(g) * (len(g) - 1) / 2 > without)
        got = jaccard_join.cheaper_without(info, start, size, cost, row)
        assert got.tolist() == want
        assert got[size > jaccard_join.most_sets(cost, row)].all()


def test_keys_that_many_batches_hold(spark, monkeypatch):
    """A key's rows that come in several batches are judged together."""
    rnd = random.Random(9)
    texts = crowd(60, 3) + [" ".join(f"s{j}" for j in range(12)) + f" e{i}" for i in range(150)] + crowd(30, 4, words=14, edits=1)
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def extended(k, sizes, times):
    """Pairs of a text and the same with words appended, by the numbers of their shingles."""
    return [(" ".join(w[: x + k - 1]), " ".join(w)) for x, y in sizes for i in range(times) for w in [[f"t{x}x{i}x{j}" for j in range(y + k - 1)]]]


def test_short_texts_and_the_same_extended(spark):
    pairs = extended(4, [(6, 7), (17, 20), (40, 47), (6, 8), (17, 21)], 8)
    rows = list(enumerate(t for p in pairs for t in p))
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_one_of_short_texts_and_the_same_extended_stays(spark):
    pairs = extended(5, [(13, 16), (12, 15), (8, 10), (16, 20), (24, 30)], 8)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()) == list(range(0, 2 * len(pairs), 2))


def test_the_texts_to_fetch_are_listed_once(spark, monkeypatch):
    given, texts_of = [], jaccard_join.texts_of
    monkeypatch.setattr(jaccard_join, "texts_of", lambda docs, text_col, classes, bits: given.append(classes) or texts_of(docs, text_col, classes, bits))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(30)]
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)
    (classes,) = given
    # Ends of pairs are gathered before; what reads the list does not make it again.
    assert "Generate" not in classes._jdf.queryExecution().toString()
    assert classes.count() == classes.distinct().count() == len(rows)
