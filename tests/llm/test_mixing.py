import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import mixing
from sparkwatch.llm.mixing import Mix

SCHEMA = "doc_id long, text string, source string, taken string"


def order(sources):
    return sorted(sources, key=lambda s: (s is None, s or ""))


def filled(sizes, weights, epochs):
    """Shares by weight, reshared until none is above its limit."""
    total, open_, target = sum(sizes.values()), set(sizes), dict.fromkeys(sizes, 0.0)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order(sizes))}
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = float(epochs * sizes[s])
        open_ -= above
    return target


def highest_quotients(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * got[k] + 1))
        got[best] += 1
    return got


def test_apportionment_against_one_seat_at_a_time(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(25):
        votes = {i: r.choice([0, 1, 5, r.randint(1, 50), r.randint(1, 5000)]) for i in range(r.randint(1, 12))}
        seats = r.randint(0, 60) if sum(votes.values()) else 0
        got = highest_quotients(votes, seats)
        for i, v in votes.items():
            rows.append((g, i, float(v), seats))
            want[g, i] = got[i]
    df = spark.createDataFrame(rows, "g long, i long, v double, s long")
    made = {(x["g"], x["i"]): x["q"] for x in mixing.apportion(df, ["g"], "i", "v", "s", "q").collect()}
    assert made == want


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000}, {"a": 0, "b": 50, None: 9}, {"é": 5, "z": 70, "Z": 900, "": 20}, {"x": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
    want = filled(sizes, (1, 2, 3), 3)
    assert got == {s: pytest.approx(v) for s, v in want.items()}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 6 + ["a", "b", None, "rare"])
        words = [r.choice("one two three fôur ".split()) for _ in range(r.choice([0, 1, 5, 40, 300]))]
        rows.append((i, None if i % 50 == 3 else r.choice([" ", "\n", "\t "]).join(words), source, "clash"))
    return rows


def test_mix(spark):
    rows = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = Mix(shard_documents=50)
    mixed = [x.asDict() for x in mixing.mix(df, spec=spec).collect()]
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sizes = Counter()
    for i, _, s, _ in rows:
        sizes[s] += size[i]
    want = filled(sizes, spec.weights, spec.epochs)
    assert len(mixed) == len(rows)
    taken = defaultdict(int)
    for x in mixed:
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s, v in want.items():
        assert abs(taken[s] - v) <= 2 * spec.block + 0.002 * v
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(df.repartition(7), spec=spec).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in mixed}

    out = mixing.apply_mix(df, mixing.mix(df, spec=spec))
    assert out.columns == df.columns
    words = {x["doc_id"]: len((x["text"] or "").split()) for x in out.collect()}
    assert words == {x["doc_id"]: x["taken"] for x in mixed if x["taken"]}


def test_taken_text():
    assert mixing.taken_text("a  b\nc d", 1, 0, 0, 0) == "a  b\nc d"
    assert mixing.taken_text("a  b\nc d", 1, 2, 4, 1) == "a  b\nc d\nc d\na"


def test_empty_and_repeated(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [(None, "a b c", "s", "x")] * 3 + [(1, None, None, "x"), (2, "", None, "x")]
    got = mixing.mix(spark.createDataFrame(same, SCHEMA)).select("size", "taken", F.col("source")).collect()
    assert sum(x["taken"] for x in got) == 9 and all(x["taken"] == 0 for x in got if x["source"] is None)  # all words there are


def test_many_tiny_sources(spark):
    """One document of one to nine words in each of 600 sources: each source comes within a word of its target."""
    rows = [(i, " ".join("w" * (1 + i % 9)), f"s{i:03d}", "x") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(abs(x["taken"] - x["target"]) <= 1 for x in got)
    assert abs(sum(x["taken"] for x in got) - sum(x["size"] for x in got)) <= 1


def test_rows_without_an_id_have_decisions_of_their_own(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{i}x{k}" for k in range(r.choice([0, 1, 3, 3, 30, 90]))) for i in range(60)] + ["equal text here"] * 3 + [None]
    rows = [(None if i % 3 else 7, t, r.choice(["hot", "hot", "a", None]), "x") for i, t in enumerate(texts)] + [(1, "only one", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for spec in (Mix(), Mix(shard_documents=8, block=5)):
        mixed = mixing.mix(df, spec=spec)
        want = Counter((x["doc_id"], x["source"], x["taken"]) for x in mixed.collect() if x["taken"])
        out = mixing.apply_mix(df, mixed).collect()
        assert Counter((x["doc_id"], x["source"], len(x["text"].split())) for x in out) == want
        of = {w: t for _, t, _, _ in rows for w in (t or "").split()}
        for x in out:  # words of one text only
            assert len({of[w] for w in x["text"].split()}) == 1
