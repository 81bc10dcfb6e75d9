import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from sparkwatch.llm import bpe, common, fertility
from sparkwatch.llm.fertility import Fertility

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines, dup, earlier = text.split("\n"), 0, set()
    for x in lines:
        dup += bool(WORD.search(x)) and x in earlier
        earlier.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def prose(r, n):
    return " ".join(r.choice("the quick brown fox jumps over a lazy dog while étés und straße glow".split()) + r.choice(["", "", ","]) for _ in range(n))


def texts():
    r = random.Random(1)
    out = ["", "one", "a\x0bb\x0cc\rd\te\x1cf g", "#*$%&|<> é€", "x\nx\n\n\n x\nx", prose(r, 19), prose(r, 20)]
    phrase = prose(r, 9)
    out += [f"{phrase} {prose(r, 30)} {phrase} {phrase}", "ha " * 50, "\n".join([prose(r, 12)] * 3 + [prose(r, 40)]), prose(r, 30_000), "x" * 50_000]
    return out + [prose(r, r.randint(20, 200)) for _ in range(60)]


def test_base_counts_against_plain_python(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(texts())] + [(900, None, "en", "x"), (None, "again", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = fertility.report(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _, _ in rows:
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t or ""), i
        assert not (r["base_failed"] and r["kept"])


def test_measures_against_the_libraries(spark):
    rows = [(i, t, None) for i, t in enumerate(texts()[:-40] + ["漢字 と かな \U0001f600 ꙮ"])]
    spec = Fertility()
    got = {r["doc_id"]: r for r in fertility.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spec=spec).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=common.vocabulary("piece_bpe_32k.model"))
    byte = common.byte_bpe(common.vocabulary("byte_bpe_multi_50k.tiktoken"))
    token = bpe.codec("byte_bpe_multi_50k.tiktoken").bytes_of

    def split(b):
        return b.decode(errors="replace") != b.decode(errors="ignore")

    for i, t, _ in rows:
        for name, ids, flags in (
            ("piece_bpe_32k", pieces.encode(t), pieces.is_byte),
            ("byte_bpe_multi_50k", byte.encode_ordinary(t), lambda k: split(token[k])),
        ):
            r, n = got[i], len(ids)
            assert r[f"chars_per_token_{name}"] == pytest.approx(len(t) / n if n else 0)
            assert r[f"byte_share_{name}"] == pytest.approx(sum(map(flags, ids)) / n if n else 0)
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) / math.log2(n) if n > 1 else 1.0
            assert r[f"entropy_{name}"] == pytest.approx(entropy)


def test_bands_keep_the_usual_and_reject_the_odd(spark):
    r = random.Random(7)
    rows = [(i, prose(r, r.randint(60, 300)), "en") for i in range(200)]
    odd = [(1000, prose(r, 200).upper().replace(" ", "!! "), "en"), (1001, " ".join(f"{r.getrandbits(64):x}" for _ in range(60)), "en"), (1002, "꙳ꙮ꙲ " * 5 + prose(r, 15) + " ꙰ꙮ꙱" * 7, "en")]
    got = {x["doc_id"]: x["kept"] for x in fertility.report(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in rows) and not any(got[i] for i, _, _ in odd)


def test_bands_against_sorted_values(spark):
    r = random.Random(3)
    values = [(r.choice("ab"), [r.random() * 5, r.random() / 10, r.random()]) for _ in range(301)]
    df = spark.createDataFrame([(lang, v, False) for lang, v in values], "lang string, m array<double>, base_failed boolean")
    spec = Fertility(vocabularies=("one",))
    got = {x["lang"]: x for x in fertility.bands(df, spec).collect()}

    def lower_median(xs):
        return sorted(xs)[(len(xs) - 1) // 2]

    for lang in ("a", "b", None):
        for k in range(3):
            unit = (16 if k == 0 else 1) / spec.bins
            bins = [int(v[k] / unit) for name, v in values if lang in (None, name)]
            mid = lower_median(bins)
            assert got[lang]["middle"][k] == pytest.approx((mid + 0.5) * unit)
            assert got[lang]["spread"][k] == pytest.approx((lower_median([abs(b - mid) for b in bins]) + 0.5) * unit * 1.4826)


def test_scripts_and_empty_tables(spark):
    assert [fertility.script(t) for t in ("", "123 !", "été", "Привет a", "漢字", "ひらがな漢", "한국어", "ไทย", "नमस्ते")] == ["other", "other", "latin", "cyrillic", "han", "kana", "hangul", "thai", "indic"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fertility.report(empty).collect() == []
    short = spark.createDataFrame([(1, "too short", "en"), (1, "too short", "en")], "doc_id long, text string, lang string")
    assert [r["kept"] for r in fertility.report(short).collect()] == [False, False]


def test_a_rare_language_in_another_script_has_bands_of_its_own(spark):
    """On both sides of any number of documents, and never by those of another script."""
    r = random.Random(5)

    def cyrillic(n):
        return " ".join(r.choice("быстрая лиса прыгает через ленивую собаку пока светит солнце над старым домом".split()) for _ in range(n))

    rows = [(i, prose(r, r.randint(60, 300)), "en") for i in range(200)]
    for k, (lang, n) in enumerate((("uk", 3), ("bg", 49), ("ru", 51))):
        rows += [(1000 * (k + 1) + i, cyrillic(r.randint(60, 300)), lang) for i in range(n)]
    got = fertility.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(x["kept"] for x in got)


def test_width_of_the_bands(spark):
    """Five deviations away is outside, three inside."""
    rows = [(off, [2.5 + off * 0.1, 0.0, 0.9], 400, [2.5, 0.0, 0.9], [0.1, 0.004, 0.01]) for off in (-5, -3, 3, 5)]
    df = spark.createDataFrame(rows, "off int, m array<double>, n_tokens long, middle array<double>, spread array<double>")
    got = {r["off"]: r["ok"] for r in df.withColumn("ok", fertility.within(Fertility(vocabularies=("one",)))).collect()}
    assert got == {-5: False, -3: True, 3: True, 5: False}


def test_letters_and_blank_lines_by_table():
    """Scripts as letter by letter, from one table of code points."""
    texts = ["", "12 !!", "abc \u0434\u043e\u043c", "\u6f22\u5b57 a", "\U00020000\U000e0100", "\u00aa\u00ba\u0430\u0431\u0432"]
    for text in texts:
        letters = [fertility._SCRIPT_OF[np.searchsorted(fertility._STARTS, ord(c), "right") - 1] for c in text if c.isalpha()]
        assert fertility.script(text) == (fertility._SCRIPTS[np.bincount(letters).argmax()] if letters else "other")
    assert len(fertility._script_table()) == 0x110000
    assert fertility.repeated_lines("a\n \t\x0b\x0c\r\na\n\n\x1c\n\x1c") == 2
