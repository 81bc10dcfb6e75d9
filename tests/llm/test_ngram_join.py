import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import ngram_join
from sparkwatch.llm.components import components
from sparkwatch.llm.ngram_join import JaccardJoin

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {(i, len(sets[i]), root[i]) for i in ids}


def corpus(seed, n=160, change=0.03):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "ÉTÉ", "x\x1cy", "The", "the"]

    def fresh():
        return [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 6, 20, 60, 120]))]

    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = [fresh() for _ in range(n // 4)]
    while len(texts) < n:
        words = list(r.choice(texts))
        kind = r.random()
        if kind < 0.2:
            pass
        elif kind < 0.7:
            words = [r.choice(vocabulary) if r.random() < change else w for w in words]
        elif kind < 0.85:
            words[len(words) // 2 : len(words) // 2] = passage
        else:
            words = fresh()
        texts.append(words)
    ids = r.sample(range(10_000), n)
    return [(i, r.choice([" ", "\n", " \t"]).join(w)) for i, w in zip(ids, texts)]


@pytest.mark.parametrize("seed,direct", [(1, 4), (2, 0), (3, 1)])
def test_against_all_pairs(spark, seed, direct):
    rows = corpus(seed) + [(20_001, None), (20_002, ""), (20_003, " \n"), (20_004, "the the"), (20_005, "THE the")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in ngram_join.near_duplicates(df, spec=JaccardJoin(direct=direct, count_bits=8, filter_bits=10, odd_parts=64 if direct else 2048)).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies(spark):
    """A chain of versions, each like the one before, and many copies of each."""
    r = random.Random(9)
    words, rows = [f"a{i}" for i in range(150)], []
    for version in range(6):
        words = list(words)
        for at in r.sample(range(150), 2):
            words[at] = f"b{version}{at}"
        for _ in range(12):
            own = list(words)
            own[r.randrange(150)] = f"c{r.random()}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join(words)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in ngram_join.near_duplicates(df, spec=JaccardJoin(direct=0)).collect()} == brute(rows)


def test_exactly_at_the_threshold(spark):
    a = [f"w{i}" for i in range(24)]  # 20 n-grams
    at = a[:22] + ["x", "y"]  # 18 shared of 22: 81.8 %
    below = a[:21] + ["x", "y", "z"]  # 17 of 23
    exact = a[:20]  # 16 of 20: 80 %
    rows = [(1, " ".join(a)), (2, " ".join(at)), (13, " ".join(f"q{i}" for i in range(24))), (14, " ".join(f"q{i}" for i in range(20))), (25, " ".join(exact[::-1])), (26, " ".join(below))]
    got = {tuple(x) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and (14, 16, 13) in got and (26, 20, 26) in got


def test_missing_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, "all alone"), (3, text + " more")]
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (None, 26, 3), (None, 1, None), (3, 27, 3)], key=str)
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert ngram_join.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0][:] == (1, 0, 1)


def test_order_keeps_sets_and_puts_rare_first():
    counts = np.array([5, 0, 9, 2])
    order = ngram_join.Order(counts, 2)
    found = (np.array([2, 0, 3, 3], np.uint64) << np.uint64(62)) | np.array([1, 2, 3, 4], np.uint64)
    keys = order.keys(found)
    assert (keys & np.uint64(7)).tolist() == [3, 4, 2, 1] and len(set((keys >> np.uint64(62)).tolist())) == 3
    assert order.parts(keys).sum() == 4


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    chain = list(range(100, 160))
    r.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(7, i) for i in range(20, 60)] + [(1, 2), (2, 1), (2, 2)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({x for link in links for x in link}, links)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.where(F.lit(False))).collect() == []


def test_near_copies_of_one_text_are_compared_with_it_first(spark, monkeypatch):
    """Copies with two changed words link with the text and with those with one, hardly ever with each other."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 181):
        copy = list(words)
        for at in (r.randrange(5, 70), r.randrange(80, 145))[: 1 if i <= 20 else 2]:
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    compared, plain = [], ngram_join._verified

    def verified(pairs, *others):
        compared.append(pairs.count())
        return plain(pairs, *others)

    monkeypatch.setattr(ngram_join, "_verified", verified)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(row) for row in found} == brute(rows) and {row["component_id"] for row in found} == {0}
    assert sum(compared) < 1000
