import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_bpe import plain
from test_mixing import filled
from test_ngram_join import brute as near_brute
from test_templates import brute as line_brute
from sparkwatch.llm.templates import Templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, ids int"


def corpus():
    r = random.Random(6)
    words = [f"{a}{b}" for a in "mor tal sen vik ul bra".split() for b in "en ar ist o und a".split()]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    rows, quality, bad = [], [], set()
    for i in range(240):
        text = "\n".join([prose(r.randint(8, 40)) for _ in range(r.randint(1, 5))])
        if i % 4 == 0:
            text = f"Copyright {r.randint(1990, 2030)} by the authors of this\n{text}"
        if i % 6 == 5:
            text = " ".join(w.upper() + "$$$" for w in prose(90).split())
            bad.add(i)
        rows.append([i, text, r.choice(["en", None]), r.choice(["a", "a", "a", "b", None])])
        quality.append((i, 0 if i in bad else 1))
    for i in range(240, 280):
        text = rows[r.choice([k for k in range(240) if k not in bad])][1].split(" ")
        text[r.randrange(len(text))] = "changed"
        rows.append([i, " ".join(text), "en", "b"])
    rows += [[900, None, None, None], [901, "", "en", "a"], [902, "short one", "en", "c"], [None, "a text without an id", "en", "c"]]
    return [(*x, len(x[1] or ""), "y", 4) for x in rows], quality, bad


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, quality, _ = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stage_by_stage(spark, folder):
    rows, _, bad = corpus()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"]

    docs = stages["quality"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).cache()
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {x[0] for x in rows} - set(texts) - {900, 901} == bad  # empty texts may go either way

    lines = stages["line_dedup"](spark, docs, folder).cache()
    gone = line_brute(list(texts.items()), Templates())
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in texts.items()}
    want = {i: t for i, t in want.items() if i not in gone or t.split()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert lines.columns == docs.columns and sum(map(len, gone.values())) > 30
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}

    near = stages["near_duplicates"](spark, lines, folder).cache()
    known = [(i, t) for i, t in want.items() if i is not None]
    first = {i for i, _, root in near_brute(known) if i == root}
    assert {r["doc_id"] for r in near.collect()} == first | {None} and near.columns == docs.columns
    assert len(first) < len(known) - 20

    mixed = stages["source_mix"](spark, near, folder).cache()
    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for s, v in filled(sizes, (1, 2, 3), 3).items():
        assert abs(taken[s] - v) <= 32
    assert mixed.columns == docs.columns

    out = stages["byte_bpe"](spark, mixed, folder)
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in out.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain(text[r["doc_id"]]) and r["round_trip"]
    # the whole run takes the same way
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, out.collect()))


def test_repeated_ids_and_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.where("doc_id in (0, 1)").unionByName(docs.where("doc_id = 1"))
    assert corpus_pipeline.one_of_each_group(spark, twice, folder).groupBy("doc_id").count().where(F.col("count") > 1).count() == 0
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == [], name
