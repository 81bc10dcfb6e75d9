import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import merkle, queries
from sparkwatch.llm.merkle import MerkleConfig

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _g string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def plain_tree(leaves, fanout):
    """(root, siblings of each leaf) by hashing whole levels."""
    proofs = [""] * len(leaves)
    level, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(k, min(k + fanout, len(level))) for k in range(0, len(level), fanout)]
        for run in runs:
            for own in run:
                for i in under[own]:
                    proofs[i] += "".join(level[j] for j in run if j != own)
        under = [[i for j in run for i in under[j]] for run in runs]
        level = [sha(*(level[j] for j in run)) for run in runs]
    return level[0], proofs


def plain_manifest(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, siblings)."""
    order = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([plain_leaf(r) for r in sorted((r for r in rows if r[2] == g), key=order)], fanout) for g in langs}
    if not trees:
        return []
    root, tops = plain_tree([trees[g][0] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops):
        subroot, proofs = trees[g]
        for r, proof in zip(sorted((r for r in rows if r[2] == g), key=order), proofs):
            out.append((r[0], plain_leaf(r), subroot, root, proof + top))
    return sorted(out, key=str)


def hostile(n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "é" * 3, "word " * r.randint(1, 50), None]), r.choice(["de", "en", "en", "en", "Z", "é"]), r.choice(["a", None]), r.choice([None, i]), "x", "y") for i in range(n)]
    rows += rows[3:4] * 9 + [(None, None, None, None, None, None, None)] * 4 + [(7, "other text", "en", "b", 1, None, None)]
    return rows + [(10**6, "long " * 100_000, "lone", "c", 2, None, None)]


@pytest.mark.parametrize("n, config", [(1, MerkleConfig()), (300, MerkleConfig(fanout=3)), (61, MerkleConfig(fanout=2, slots=2)), (500, MerkleConfig(fanout=20))])
def test_against_whole_levels(spark, n, config):
    rows = hostile(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = merkle.manifest(docs, config).collect()
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in out), key=str)
    assert got == plain_manifest(rows, config.fanout)


@pytest.mark.parametrize("fanout", [2, 5])
def test_groups_of_all_sizes_fold_to_the_root(spark, fanout):
    rows = [(i, "t", f"g{n}", "s", i, None, None) for n in (1, 2, 3, 16, 17, 33) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    done = merkle.manifest(docs, MerkleConfig(fanout=fanout)).withColumn("again", merkle.proven_root(F.col("leaf"), fanout)).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in done), key=str) == plain_manifest(rows, fanout)
    assert len({(r["again"], r["root"]) for r in done}) == 1 and done[0]["again"] == done[0]["root"]


def test_one_group_of_one_row(spark):
    (done,) = merkle.report(spark.createDataFrame([(3, "t", None, "s", 1, None, None)], SCHEMA)).collect()
    assert done["leaf"] == done["subroot"] == done["root"] and done["proof_sha256"] == sha()


def test_tampered_rows_do_not_fold_to_the_root(spark):
    rows = hostile(200, 5)
    out = merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()
    chars = {}
    for r in rows:
        chars.setdefault(plain_leaf(r), r)
    assert len(out) == len(rows)
    for r in out:
        row = chars[r["leaf"]]
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
    assert {r["verified"] for r in out} == {True, False}


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("extra", [False, True])
def test_query_against_sql(spark, tmp_path, extra):
    sf = "/root/testdata/sf0.001"
    if extra:
        rows = spark.createDataFrame(hostile(50), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
        sf = str(tmp_path)
        rows.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet{'/*.parquet' if extra else ''}'")
    want = con.execute(merkle.ORACLE).fetchall()
    got = [tuple(r) for r in queries.merkle_manifest(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
