import random

import numpy as np

from sparkwatch.llm import quality
from sparkwatch.llm.quality import N_FEATURES, Training


def test_passages_against_one_text_at_a_time():
    r = random.Random(2)
    texts = ["", "  \n", "one", "word " * 64, "word " * 65, " ".join(r.choice("ab Cd %% || é 1".split()) for _ in range(500))]
    x, counts = quality.encode_passages([t.encode() for t in texts])
    assert counts.tolist() == [1, 1, 1, 1, 2, 8] and x.shape == (14, N_FEATURES)
    assert not x[0].any() and not x[1].any()
    at = 0
    for t, n in zip(texts, counts):
        alone, _ = quality.encode_passages([t.encode()])
        assert np.allclose(alone, x[at : at + n])
        at += n
    m = quality.CLASSES**2
    assert np.allclose(x[2, m:], [np.log1p(1) / 4, 0.4, 1, 0, 0])  # three letters and the line's end
    assert np.allclose(x[3, m + 2 : m + 4], [1 / 64, 63 / 64])


def test_every_passage_counts():
    """A long text with one bad passage at its very end is not encoded as the same text without it."""
    good = "plain words in a row " * 4000
    a, _ = quality.encode_passages([good.encode()])
    b, _ = quality.encode_passages([(good + "%%% $$$ " * 64).encode()])
    assert len(b) > len(a) and np.abs(b[-1] - a[-2]).max() > 0.3


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    counts = np.array([2, 1, 3])
    x, y = r.normal(size=(6, N_FEATURES)), np.array([1.0, 0.0, 1.0])
    shape = {"embed": (N_FEATURES, 5), "embed_bias": (5,), "attend": (5, 4), "gate": (5, 4), "pick": (4,), "score": (5,), "bias": ()}
    w = {k: r.normal(0, 0.3, s) for k, s in shape.items()}

    def loss():
        p = quality._forward(w, x, counts)["logit"]
        return np.mean(np.log1p(np.exp(-np.where(y > 0, p, -p))))

    grads = quality._gradients(w, x, counts, y)
    for k, s in shape.items():
        at = tuple(int(r.integers(0, n)) for n in s)
        kept = w[k][at] if s else w[k]
        values = []
        for d in (1e-5, -1e-5):
            if s:
                w[k][at] = kept + d
            else:
                w[k] = kept + d
            values.append(loss())
        if s:
            w[k][at] = kept
        else:
            w[k] = kept
        assert np.isclose((values[0] - values[1]) / 2e-5, np.asarray(grads[k])[at], rtol=1e-4, atol=1e-8), k


def bags(n, seed):
    """Good texts, and texts that are good but for one passage."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("some of these words stand for quite ordinary prose here".split()) for _ in range(r.randint(70, 400))]
        bad = i % 2
        if bad:
            at = r.randrange(len(words))
            words[at:at] = ["#%&" + r.choice("abc") for _ in range(64)]
        rows.append((i, " ".join(words), 1 - bad))
    return rows


def test_held_out_accuracy(spark):
    rows = bags(600, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "", "x"), (5, rows[5][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 9) for i, _, q in rows] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, score int")
    got = quality.report(docs, labels, spec=Training(epochs=15)).collect()
    assert len(got) == len(rows) + 4
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert all(0 <= s <= 1 for scores in by.values() for s in scores)
    assert by[5][0] == by[5][1] and by[9000] == by[9001] == by[None]


def test_one_passage_of_two_hundred_decides(spark):
    """Long texts whose label hangs on one passage anywhere in them: it is in the bag while learning."""
    r = random.Random(11)
    rows = []
    for i in range(160):
        words = [r.choice("some of these words stand for quite ordinary prose here".split()) for _ in range(64 * 200)]
        if i % 2:
            at = 64 * r.randrange(200)
            words[at : at + 64] = ["#%&" + r.choice("abc") for _ in range(64)]
        rows.append((i, " ".join(words), 1 - i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality.report(docs, labels, spec=Training(epochs=40, batch=16)).collect()
    held = [x for x in got if x["held_out"]]
    assert len(held) > 20 and np.mean([x["predicted"] == 1 - x["doc_id"] % 2 for x in held]) > 0.9


def test_the_sample_has_whole_documents(spark):
    """A bound on passages leaves documents out of the sample, never passages of a document that is in it."""
    rows = bags(200, 4) + [(500, "long " * 64 * 90, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality.report(docs, labels, spec=Training(epochs=30, passages=800)).collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] < 500]
    assert np.mean([x["predicted"] == 1 - x["doc_id"] % 2 for x in held]) > 0.8


def test_held_out_labels_are_not_used(spark):
    rows = bags(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {r["doc_id"] for r in docs.select("doc_id", (quality.remainder(docs.doc_id, 5) == 0).alias("h")).collect() if r["h"]}
    flipped = [(i, (1 - q) if i in held else q) for i, _, q in rows]
    a = quality.report(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.report(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in quality.report(docs, none).collect()] == [(0.5, 1)] * 2
    assert quality.report(docs.limit(0), none).collect() == []
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2
