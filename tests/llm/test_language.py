import random
import zlib

import numpy as np
import zstandard

from sparkwatch.llm import language
from sparkwatch.llm.language import Languages

VOICES = {"aa": "ka ro mi ta sen lu".split(), "bb": "ung sch ver ich keit ber".split(), "cc": "tion eau oir ent que lle".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(VOICES))
        text = " ".join("".join(r.choices(VOICES[lang], k=r.randint(1, 4))) for _ in range(r.randint(20, 200)))
        rows.append((i, text, lang))
    return rows


def test_sizes_against_fresh_compressors():
    r = random.Random(1)
    contents = tuple((lang, " ".join(r.choices(VOICES[lang], k=900)).encode()) for lang in sorted(VOICES))
    text = " ".join(r.choices(VOICES["bb"], k=3000))
    spec = Languages(block=700)
    want = []
    for _, content in contents:
        total = 0
        for i in range(0, len(text), spec.block):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=spec.level)
            c = zstandard.ZstdCompressor(level=spec.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            total += len(c.compress(text[i : i + spec.block].encode()))
        want.append(total)
    assert language.sizes(text, contents, spec).tolist() == want
    assert contents[int(np.argmin(want))][0] == "bb"


def test_decisions():
    spec = Languages(margin=0.1)
    assert language.decide(np.array([50, 40, 60]), spec)[0] == 1 and language.decide(np.array([50, 40, 60]), spec)[2]
    best, score, accepted = language.decide(np.array([40, 40]), spec)
    assert (best, score, accepted) == (0, 0.5, False)
    assert language.decide(np.array([7]), spec) == (0, 1.0, True)


def test_held_out_accuracy(spark):
    rows = corpus(400)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, rows[0][1], None), (None, rows[1][1], "aa"), (1004, rows[2][1] * 60, rows[2][2])]
    docs = spark.createDataFrame([(*x, 1) for x in rows + odd], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language.report(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"] and i is not None and i < 1000} == set(held)
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[1003]["lang_pred"] == got[0]["lang_pred"] and got[1003]["score"] == got[0]["score"]
    assert got[1004]["lang_pred"] == rows[2][2]


def test_every_language_is_learned(spark):
    """Seventy invented languages; none is left out, and with fewer pieces for each they are still told apart."""
    import random

    r = random.Random(7)
    words = {k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(40)] for k in range(70)}
    rows = [(70 * n + k, " ".join(r.choice(words[k]) for _ in range(60)), f"l{k:02d}") for k in range(70) for n in range(8 if k < 60 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.report(docs, spec=Languages(all_pieces=210)).collect()}
    held = [x for x in rows if got[x[0]]["held_out"]]
    assert {x[2] for x in held if int(x[2][1:]) >= 60}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95


def test_only_the_learned_rows_matter(spark):
    rows = corpus(120, 2)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    b = spark.createDataFrame([(i, t, "zz" if i in held else lang) for i, t, lang in rows], a.schema).repartition(3)
    assert sorted(language.report(a).collect()) == sorted(language.report(b).collect())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(2, "some text", None)], "doc_id long, text string, lang string")
    assert language.report(docs).collect()[0]["lang_pred"] == "und"
    assert language.report(docs.limit(0)).collect() == []
