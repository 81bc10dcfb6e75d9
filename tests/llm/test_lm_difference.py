import math
import random
import re
import tracemalloc
from collections import Counter

import pytest

from sparkwatch.llm import lm_difference
from sparkwatch.llm.lm_difference import BigramModels


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target, spec):
    """The same models with dictionaries, words as they are. Ties at the end of a list must not matter."""
    words = Counter(w for _, t in rows for w in tokens(t))
    known = {w for w, _ in words.most_common(spec.words)}

    def bigrams(text):
        ids = [w if w in known else None for w in tokens(text)]
        return list(zip(["<begin>", *ids[:-1]], ids))

    sides = {}
    sides["background"] = Counter(b for _, t in rows for b in bigrams(t))
    sides["target"] = Counter(b for i, t in rows if i in target for b in bigrams(t))
    listed = {b for b, _ in sides["background"].most_common(spec.bigrams)}
    scale = {"target": 1.0, "background": sum(sides["target"].values()) / sum(sides["background"].values())}
    out = {}
    for i, text in rows:
        found = bigrams(text)
        line = [len(found)]
        for side, counts in sides.items():
            word, history = Counter(), Counter()
            for (h, w), n in counts.items():
                word[w] += n * scale[side]
                history[h] += n * scale[side]
            total, size = sum(word.values()), len(known) + 2
            loss = 0.0
            for h, w in found:
                seen = counts[h, w] * scale[side] if (h, w) in listed else 0.0
                loss -= math.log((seen + spec.prior * (word[w] + 1) / (total + size)) / (history[h] + spec.prior))
            line.append(loss / len(found) if found else None)
        out[i] = (line[0], line[2], line[1])
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    good, bad = "the fine old house stood on a green hill by the sea".split(), "CLICK here now for free stuff and win win big".split()
    return [(i, r.choice([" ", "\n"]).join(r.choice(good if i % 3 else bad) for _ in range(r.randint(5, 60)))) for i in range(n)]


def test_against_dictionaries(spark):
    spec = BigramModels(prior=3.0)
    rows = corpus() + [(900, None), (901, ""), (902, "Words never seen Été"), (903, "the " * 5000)]
    target = {i for i, _ in rows if i % 6 == 1 and i < 900}
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)
    ids = spark.createDataFrame([(i, 1.0) for i in sorted(target)] + [(None, 1.0), (1, 1.0)], "doc_id long, difference double")
    want = brute(rows, target, spec)
    got = lm_difference.score(df, ids, spec=spec).collect()
    assert len(got) == len(rows)
    for r in got:
        n, a, b = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert r["loss_target"] == (None if a is None else pytest.approx(a, abs=1e-8))
        assert r["loss_background"] == (None if b is None else pytest.approx(b, abs=1e-8))
    by = {r["doc_id"]: r["difference"] for r in got}
    assert min(by[i] for i, _ in rows if i < 900 and i % 3) > max(by[i] for i, _ in rows if i < 900 and i % 3 == 0)


def test_short_lists(spark):
    """Words and bigrams beyond the lists fall back."""
    rows = [(1, "a a a a b b b c c d"), (2, "a b a b a b a b e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    ids = df.where("doc_id = 2")
    spec = BigramModels(words=2, bigrams=1, prior=1.0)
    want = brute(rows, {2}, spec)
    got = {r["doc_id"]: r for r in lm_difference.score(df, ids, spec=spec).collect()}
    for i in (1, 2):
        assert got[i]["loss_target"] == pytest.approx(want[i][1], abs=1e-8) and got[i]["loss_background"] == pytest.approx(want[i][2], abs=1e-8)


def test_without_target_or_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lm_difference.score(df, none).collect()[0][:] == (1, 2, None, None, None)
    assert lm_difference.score(df.limit(0), none).collect() == []


@pytest.mark.parametrize("sent", [0, 5, 1 << 18])
def test_models_grow_with_the_input(spark, sent):
    """More words and bigrams than lists of fixed sizes would hold, and the rare ones count."""
    rows = [(i, " ".join(f"w{i}x{k} w{i}y{k // 2} common" for k in range(200))) for i in range(120)]
    rows += [(500 + i, " ".join(f"w{i}x{k} w{i}y{k // 2} common" for k in range(0, 200, 3))) for i in range(0, 120, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = {i for i, _ in rows if i < 120 and i % 10 == 0}
    assert len({w for _, t in rows for w in t.split()}) > 32_000
    got = {r["doc_id"]: r for r in lm_difference.score(df, spark.createDataFrame([(i,) for i in target], "doc_id long"), spec=BigramModels(sent=sent)).collect()}
    want = brute(rows, target, BigramModels())
    for i, _ in rows:
        assert got[i]["loss_target"] == pytest.approx(want[i][1], abs=1e-8) and got[i]["loss_background"] == pytest.approx(want[i][2], abs=1e-8)


def test_many_groups_and_parts(spark, monkeypatch):
    """Texts of more than a group, repeated rows and ids, and ids that are missing."""
    monkeypatch.setattr(lm_difference, "_GROUP_BYTES", 700)
    rows = corpus(seed=3, n=80) + [(7, "a second text of seven"), (None, "the house by the sea"), (1000, "the hill " * 400), (1001, None), (1001, "")]
    df = spark.createDataFrame(rows + [rows[12]], "doc_id long, text string").repartition(2)
    assert lm_difference.grouped(df).count() > 20
    target = {i for i, _ in rows if i is not None and i % 5 == 2 or i == 1000}
    numbered = list(enumerate(rows + [rows[12]]))
    want = brute([(k, t) for k, (_, t) in numbered], {k for k, (i, _) in numbered if i in target}, BigramModels())
    got = lm_difference.score(df, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()

    def line(i, n, a, b):
        return (-1 if i is None else i, n, *(-1.0 if x is None else round(x, 7) for x in (a, b)))

    mine = sorted(line(r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got)
    for x, y in zip(mine, sorted(line(i, *want[k]) for k, (i, _) in numbered), strict=True):
        assert x == pytest.approx(y, abs=1e-6)


def test_a_bigram_is_sent_in_a_few_bytes(spark):
    """Keys, both counts and what its words need, where hardly a bigram comes twice; a row of key, history, word and counts took 34."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.3)) % 40_000}" for _ in range(3_000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    groups = lm_difference.grouped(df).selectExpr("*", "array(0, 1, 2) AS aimed")
    shared = spark.sparkContext.broadcast((lm_difference.Vocabulary(None), None))
    sent = lm_difference.asked(groups, 3, shared).toPandas()
    bigrams = {b for _, t in rows for b in zip(["<begin>", *t.split()[:-1]], t.split())}
    assert sent["n"][sent["kind"] == 0].sum() == len(bigrams) > 100_000
    assert (sent["keys"].map(len) + sent["counts"].map(len)).sum() < 10 * len(bigrams)


def test_packed_numbers():
    numbers = lm_difference.np.array([0, 1, 2**63, 2**64 - 1, 77], "uint64")
    assert lm_difference.unpacked(lm_difference.packed(numbers), 5).tolist() == numbers.tolist()
    assert lm_difference.unpacked(lm_difference.packed(numbers[:0]), 0).tolist() == []


class Caught:
    """Takes the place of a DataFrame, and keeps the function that was to run in its tasks."""

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, work, schema):
        self.work = work
        return self

    applyInArrow = mapInArrow


def most_memory(work):
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        out = work()
        return out, tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


def test_memory_of_a_part():
    """What a task holds that adds up a part of many groups, in bytes a key that came; with all counts as numbers at a time it was 87 and 90."""
    r = random.Random(8)
    shared = type("Shared", (), {"value": (lm_difference.Vocabulary(None), None)})

    def batch_of(group):
        sink = lm_difference.pa.BufferOutputStream()
        text = lm_difference.pa.table({"text": [" ".join(f"w{r.randrange(50_000)}" for _ in range(500)) for _ in range(50)]})
        with lm_difference.pa.ipc.new_stream(sink, text.schema) as out:
            out.write_table(text)
        return lm_difference.pa.record_batch({"group": [group], "aimed": [list(range(10))], "texts": [sink.getvalue().to_pybytes()]})

    asking = lm_difference.asked(Caught(), 1, shared).work
    asks = [x for group in range(40) for x in asking(iter([batch_of(group)]))]
    table = lm_difference.pa.Table.from_batches(asks)
    telling = lm_difference.told(Caught()).work
    for kind, most_allowed in ((0, 60), (1, 40)):
        part = table.filter(lm_difference.pc.equal(table["kind"], kind))
        answer, most = most_memory(lambda: telling(part))
        assert sorted(answer["group"].to_pylist()[1:]) == sorted(part["group"].to_pylist())
        assert most < most_allowed * sum(part["n"].to_pylist())
