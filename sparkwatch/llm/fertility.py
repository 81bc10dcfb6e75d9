"""Tokeniser fertility: what public vocabularies make of a text, and bands outside of which a text is rejected.

For each vocabulary a text has characters per token, the share of tokens that are bytes of split characters, and the entropy of its tokens
relative to the most that so many tokens can have. A language's bands are its median plus or minus a number of
scaled median deviations, from exact counts of finely binned values of all its documents that pass the base rules. They are drawn
towards the bands of the text's main script, the more the fewer documents a language has; where ``lang`` is missing the script's
bands hold alone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.bpe import codec
from sparkwatch.llm.common import over_batches, texts_of, vocabulary, words_by_text
from sparkwatch.session import stored

#: First code points of blocks and the script they belong to.
_BLOCKS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([b for b, _ in _BLOCKS], np.uint32)
_SCRIPTS = sorted({s for _, s in _BLOCKS})
_SCRIPT_OF = np.array([_SCRIPTS.index(s) for _, s in _BLOCKS])
_WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_LAYOUT = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


@dataclass(frozen=True)
class Fertility:
    """Vocabularies (names of public ones, or absolute paths on the workers) and how wide the bands are."""

    vocabularies: tuple[str, ...] = ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
    #: Scaled median deviations from the median for a text of ``reference_tokens`` or more; shorter ones get more room.
    width: float = 3.5
    reference_tokens: int = 400
    #: Least deviation, in the measure's own unit: characters per token, share, relative entropy.
    least: tuple[float, float, float] = (0.05, 0.004, 0.01)
    #: A script's bands count as much as this many documents of the language.
    documents: int = 50
    bins: int = 1000


def repeated_words(hashes: np.ndarray, window: int = _WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    ranked = np.sort(rolled)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    marks = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(np.isin(rolled, twice))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """The number of each code point's script; one more than the last for what is no letter."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letters = np.array([chr(x).isalpha() for x in range(sys.maxunicode + 1)])
    return np.where(letters, _SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1], len(_SCRIPTS)).astype(np.uint8)


def script(text: str) -> str:
    """The script of most visible characters beyond ASCII punctuation and digits; ``other`` if there are none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = np.bincount(_script_table()[points], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[found.argmax()] if found.any() else "other"


@lru_cache(maxsize=4)
def _encoder(name: str):
    """(texts to ids, table of the ids that stand for bytes of split characters)."""
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=name if name.startswith("/") else vocabulary(name))
        return pieces.encode, np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
    bytes_ = codec(name)

    def partial(token: bytes) -> bool:
        try:
            token.decode()
            return False
        except UnicodeDecodeError:
            return True

    return bytes_.encode, np.array([partial(t) for t in bytes_.bytes_of])


def token_measures(ids: list[int], n_chars: int, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """(tokens, characters per token, share of byte tokens, relative entropy); a text without tokens has 0, 0, 0, 1."""
    if not ids:
        return 0, 0.0, 0.0, 1.0
    ranked = np.sort(np.array(ids, np.int32))
    runs = np.diff(np.append(np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))), len(ranked)))
    share = runs / len(ranked)
    entropy = -(share * np.log2(share)).sum() / np.log2(len(ranked)) if len(ranked) > 1 else 1.0
    return len(ranked), n_chars / len(ranked), float(is_byte[ranked].mean()), float(entropy)


_BASE = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def measure(df: DataFrame, spec: Fertility = Fertility()) -> DataFrame:
    """From ``doc_id, text, lang``: the base counts, ``lang``, ``script`` and ``m``, three measures per vocabulary.

    ``m`` holds, for each vocabulary in turn, characters per token, byte share and relative entropy; ``n_tokens`` is that of the first.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        raw = [t.encode() for t in texts]
        columns: list[list] = [[] for _ in range(8)]
        for i, hashes in words_by_text(raw):
            spaces = raw[i].translate(_LAYOUT).count(b" ")
            n, repeats = len(hashes), repeated_words(hashes)
            found, tokens = [], 0
            for k, name in enumerate(spec.vocabularies):
                encode, is_byte = _encoder(name)
                n_tokens, *three = token_measures(encode(texts[i]), len(texts[i]), is_byte)
                found += three
                tokens = tokens if k else n_tokens
            symbols = len(raw[i]) - len(raw[i].translate(None, _SYMBOLS))
            row = (n, len(texts[i]) - spaces, symbols, repeated_lines(texts[i]), repeats, n < 20 or 100 * repeats > 30 * n, tokens, found)
            for column, value in zip(columns, row):
                column.append(value)
        scripts = pa.array([script(t) for t in texts], pa.string())
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.list_(pa.float64())]
        arrays = [batch.column("doc_id"), batch.column("lang").cast(pa.string()), scripts, *[pa.array(c, t) for c, t in zip(columns, kinds)]]
        names = ["doc_id", "lang", "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "m"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return over_batches(df.select("doc_id", "text", "lang"), work, f"{_BASE}, n_tokens long, m array<double>")


def bands(measured: DataFrame, spec: Fertility = Fertility()) -> DataFrame:
    """``lang, middle, spread``: median and scaled median deviation of each measure, by language, and once for all under the null language.

    Counts of binned values stand for the values, so the tables that are ordered have at most ``bins`` rows per language and measure.
    """
    good = measured.where(~F.col("base_failed")).select("lang", F.posexplode("m").alias("k", "v"))
    size = F.when(F.col("k") % 3 == 0, 16.0).otherwise(1.0) / spec.bins
    binned = good.withColumn("bin", F.least(F.floor(F.col("v") / size), F.lit(spec.bins)).cast("int"))
    counts = binned.groupBy("lang", "k", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = stored(counts.unionByName(counts.withColumn("lang", F.lit(None).cast("string"))).groupBy("lang", "k", "bin").agg(F.sum("n").alias("n")))

    middle = _weighted_median(both, "bin").select(F.col("lang").alias("_lang"), F.col("k").alias("_k"), F.col("at").alias("mid"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("k") == F.col("_k"))
    away = both.join(middle, same).select("lang", "k", F.abs(F.col("bin") - F.col("mid")).alias("off"), "n", "mid")
    off = _weighted_median(away.groupBy("lang", "k", "off", "mid").agg(F.sum("n").alias("n")), "off", ["mid"])
    unit = F.when(F.col("k") % 3 == 0, 16.0).otherwise(1.0) / spec.bins
    rows = off.select("lang", "k", ((F.col("mid") + 0.5) * unit).alias("middle"), ((F.col("at") + 0.5) * unit * 1.4826).alias("spread"), "total")
    packed = F.array_sort(F.collect_list(F.struct("k", "middle", "spread")))  # three entries per vocabulary
    tables = rows.groupBy("lang").agg(packed.alias("t"), F.max("total").alias("n_documents"))
    return tables.select("lang", "n_documents", F.transform("t", lambda x: x["middle"]).alias("middle"), F.transform("t", lambda x: x["spread"]).alias("spread"))


def _weighted_median(counts: DataFrame, value: str, also: list[str] = ()) -> DataFrame:
    each = Window.partitionBy("lang", "k")
    upto = F.sum("n").over(each.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("total", F.sum("n").over(each)).where(F.col("_upto") * 2 >= F.col("total"))
    return ranked.groupBy("lang", "k", *also).agg(F.min(value).alias("at"), F.first("total").alias("total"))


def within(spec: Fertility) -> Column:
    """Whether the measures of a row are inside its bands: bounds on both sides for characters per token, the byte share
    not too high, the entropy not too low."""
    room = spec.width * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(spec.reference_tokens)) / F.greatest(F.col("n_tokens"), F.lit(1))))
    verdict = F.lit(True)
    for i in range(3 * len(spec.vocabularies)):
        off = F.get("m", F.lit(i)) - F.get("middle", F.lit(i))
        limit = room * F.greatest(F.get("spread", F.lit(i)), F.lit(spec.least[i % 3]))
        verdict = verdict & ((F.abs(off) <= limit) if i % 3 == 0 else (off <= limit) if i % 3 == 1 else (off >= -limit))
    return verdict


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spec: Fertility = Fertility()) -> DataFrame:
    """Per document: the base counts, ``base_failed``, the measures of each vocabulary, and ``kept``.

    A missing text counts as empty: it fails the base rules, as do all texts under 20 words. Repeated rows get equal verdicts. Where no document of a language or script passes the
    base rules it has no bands and nothing of it is kept. Other columns are not read.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    measured = stored(measure(rows, spec))
    joined = measured
    for c, known in (("lang", measured.where(F.col("lang").isNotNull())), ("script", measured)):
        found = bands(known.select(F.col(c).alias("lang"), "m", "base_failed"), spec).where(F.col("lang").isNotNull())
        found = stored(found.select(F.col("lang").alias(f"_{c}"), *[F.col(x).alias(f"_{c}_{x}") for x in ("n_documents", "middle", "spread")]))
        joined = joined.join(found, F.col(c) == F.col(f"_{c}"), "left")
    own = F.col("_lang_n_documents") / (F.col("_lang_n_documents") + F.lit(float(spec.documents)))
    for c in ("middle", "spread"):
        drawn = F.zip_with(f"_lang_{c}", f"_script_{c}", lambda x, y: x * own + y * (1 - own))
        joined = joined.withColumn(c, F.coalesce(drawn, f"_lang_{c}", f"_script_{c}"))
    parts = []
    for i, name in enumerate(spec.vocabularies):
        for j, kind in enumerate(("chars_per_token", "byte_share", "entropy")):
            parts.append(F.get("m", F.lit(3 * i + j)).alias(f"{kind}_{name.rsplit('/', 1)[-1].split('.')[0]}"))
    kept = ~F.col("base_failed") & F.coalesce(within(spec), F.lit(False))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(*base, kept.alias("kept"), "n_tokens", *parts)
