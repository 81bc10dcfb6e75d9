import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sparkwatch.llm import ordermin
from sparkwatch.llm.ordermin import OrderMin, as_text, likeness


def brute(spec, text):
    """k-mers with occurrence numbers, all functions one value at a time."""
    if not text:
        return np.zeros(spec.slots, np.uint32)
    points = [ord(c) for c in text] + [0] * max(0, spec.k - len(text))
    top = (1 << 64) - 1

    def mixed(x):
        return int(ordermin.mix(np.array([x & top], np.uint64))[0])

    kmers = []
    for i in range(len(points) - spec.k + 1):
        h = 0
        for c in points[i : i + spec.k]:
            h = (h * int(ordermin._FACTOR) + c + 1) & top
        kmers.append(mixed(h))
    while len(kmers) < spec.tuple_size:
        kmers.append(kmers[0])
    seen, numbered = {}, []
    for h in kmers:
        occurrence = seen.get(h, 0)
        seen[h] = occurrence + 1
        numbered.append(mixed(h + occurrence * int(ordermin._FACTOR)) >> 32)
    out = []
    for a, b in zip(*spec._functions()):
        ranked = sorted(range(len(kmers)), key=lambda i: (((numbered[i] ^ int(b)) * int(a)) & 0xFFFFFFFF, i))
        value = 0
        for i in sorted(ranked[: spec.tuple_size]):
            value = mixed(value * int(ordermin._FACTOR) + kmers[i] + 1)
        out.append(value >> 32)
    return np.array(out, np.uint32)


def test_against_brute_force():
    r = random.Random(1)
    for spec in (OrderMin(k=3, slots=16, tuple_size=2), OrderMin(k=5, slots=8, tuple_size=3)):
        for n in (0, 1, 2, 3, 4, 7, 50, 200):
            text = "".join(r.choice("abcé") for _ in range(n))
            assert (spec.of(text) == brute(spec, text)).all(), (spec, text)


def test_stretches_do_not_matter(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(5000))
    spec = OrderMin()
    whole = spec.of(text)
    monkeypatch.setattr(ordermin, "_STRIDE", 100)
    assert (spec.of(text) == whole).all()
    monkeypatch.setattr(ordermin, "_PACKED", 3)
    assert (spec.of(text) == whole).all()


def test_order_counts():
    words = [f"w{i:04d}" for i in range(400)]
    text, spec = " ".join(words), OrderMin()
    swapped = " ".join(words[200:] + words[:200])
    edited = " ".join(words[:380] + ["other"] * 20)
    assert likeness(spec.of(text), spec.of(text)) == 1.0
    assert likeness(spec.of(text), spec.of(edited)) > likeness(spec.of(text), spec.of(swapped)) > 0.2
    assert likeness(spec.of(text), spec.of("")) == 0.0


def test_report_against_a_list(spark):
    r = random.Random(3)
    texts = {i: "".join(r.choice("abc de") for _ in range(r.randint(0, 60))) for i in r.sample(range(-500, 5000), 90)}
    texts[7000] = None
    texts[7001] = "x" * 30_000
    rows = [(i, t, 1.0) for i, t in texts.items()] + [(None, "last one", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket double").repartition(5)
    got = {r["doc_id"]: r for r in ordermin.edited_report(df).collect()}
    order = sorted(texts, reverse=True) + [None]
    texts[None] = "last one"
    spec = OrderMin()
    assert len(got) == len(order)
    for i, here in enumerate(order):
        text, following = texts[here] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[here]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == as_text(spec.of(text)) and row["edited_fingerprint"] == as_text(spec.of(edited))
        assert row["near_edited"] == likeness(spec.of(text), spec.of(edited))
        assert row["near_next"] == likeness(spec.of(text), spec.of(following))


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert ordermin.edited_report(spark.createDataFrame([], schema)).collect() == []
    one = ordermin.edited_report(spark.createDataFrame([(5, "abcdef")], schema)).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    twice = ordermin.edited_report(spark.createDataFrame([(5, "b"), (5, "a"), (5, "a")], schema)).collect()
    assert len(twice) == 3
    nulls = ordermin.edited_report(spark.createDataFrame([(None, None), (None, "ab")], schema)).collect()
    assert sorted(r["n_chars"] for r in nulls) == [0, 2]


def test_columns(spark):
    df = spark.createDataFrame([("same text", "x"), ("same text", "y"), (None, "z")], "text string, fingerprint string")
    out = ordermin.fingerprints(df)
    assert out.columns == ["text", "fingerprint"]
    a, b, c = [r["fingerprint"] for r in out.collect()]
    assert a == b != c and c == "0" * 512
    near = out.select(ordermin.fingerprint_likeness(F.col("fingerprint"), F.lit(a), 64)).collect()
    assert [r[0] for r in near] == [1.0, 1.0, 0.0]
