import random

import numpy as np
import pytest

from sparkwatch.llm import bpe, common, packing
from sparkwatch.llm.packing import Packing


def slow_best_fit(sizes, length):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [k for k in range(len(rows)) if room[k] >= sizes[i]]
        if not fits:
            rows.append([])
            room.append(length)
            fits = [len(rows) - 1]
        least = min(room[k] for k in fits)
        rows[next(k for k in fits if room[k] == least)].append(i)
        room[next(k for k in fits if room[k] == least)] -= sizes[i]
    return rows


@pytest.mark.parametrize("length", [1, 2, 7, 8, 100])
def test_best_fit_against_trying_all_rows(length):
    r = random.Random(length)
    for n in (0, 1, 5, 200):
        sizes = [r.randint(1, length) for _ in range(n)]
        made = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in made for i in row) == list(range(n))
        assert all(sum(sizes[i] for i in row) <= length for row in made)
        # which of several rows with equal room is taken does not change what is left
        assert sorted(sum(sizes[i] for i in row) for row in made) == sorted(sum(sizes[i] for i in row) for row in slow_best_fit(sizes, length))


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("some words of text été".split()) for _ in range(r.choice([0, 3, 30, 200, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (None, "no id"), (None, "no id"), (None, "none either")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(4)
    spec = Packing(length=64, shard_documents=40)
    packed = packing.pack(df, spec=spec)
    for x in packed.collect():
        assert len(x["ids"]) == len(x["positions"]) == 2 * spec.length and x["lengths"][0] == 0 and x["lengths"][-1] == x["n_tokens"]
        ids, places = np.frombuffer(x["ids"], "<u2"), np.frombuffer(x["positions"], "<u2")
        assert (ids[x["n_tokens"] :] == spec.end).all() and not places[x["n_tokens"] :].any()
        for a, b in zip(x["lengths"], x["lengths"][1:]):
            assert (places[a:b] == np.arange(b - a)).all()
        assert len(x["doc_ids"]) == len(x["pieces"]) == len(x["lengths"]) - 1
    got = [(x["doc_id"], x["piece"], x["n_pieces"], bytes(x["ids"])) for x in packing.unpack(packed, spec).collect()]
    want, codec = [], bpe.Codec(common.vocabulary(bpe.VOCABULARY))
    for i, t in rows:
        data = np.array([*codec.encode(t or ""), spec.end], "<u2")
        parts = [data[k : k + 64].tobytes() for k in range(0, len(data), 64)]
        want += [(i, k, len(parts), p) for k, p in enumerate(parts)]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = packing.pack(df.repartition(2), spec=spec)
    assert sorted(map(str, again.collect())) == sorted(map(str, packed.collect()))


def test_empty_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).collect() == []
    packing.write(packing.pack(spark.createDataFrame([(1, "a b")], df.schema)), str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 1
