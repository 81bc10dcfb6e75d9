"""Language identification by compression.

Each language has a zstandard dictionary of raw text, put together from pieces of labelled documents. A text is compressed,
block by block, once with each dictionary; the language whose dictionary makes it smallest is
predicted. Where the second best is nearly as small, the prediction is rejected.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.common import remainder

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Languages:
    """Up to ``pieces`` documents of each language give at most ``piece_chars`` code points each; with many languages fewer do, so that
    all dictionaries hold about ``all_pieces`` together (one of each language at least). Every language that has a text is learned."""

    pieces: int = 256
    piece_chars: int = 1024
    all_pieces: int = 16_384
    slack: int = 4
    level: int = 9
    block: int = 4096
    #: Least lead of the best over the second best, as a share of the second best.
    margin: float = 0.01
    #: Saved bytes by which the odds of the best language grow e-fold.
    bytes_per_nat: float = 4.0
    seed: int = 5


def _drawn(known: DataFrame, shares: dict[str, float], spec: Languages) -> list:
    """The pieces with the smallest draws of each language, among that share of its documents."""
    bounds = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, min(2**63 - 1, int(share * 2**64) - 2**63))])
    draw = F.xxhash64(F.lit(spec.seed), "doc_id", "lang")
    marked = known.where(F.col("lang").isin(list(shares))).select("lang", draw.alias("draw"), "doc_id", "text")
    marked = marked.where(F.col("draw") <= F.element_at(bounds, F.col("lang")))
    begin = F.pmod(F.col("draw"), F.greatest(F.length("text") - spec.piece_chars + 1, F.lit(1))) + 1
    marked = marked.withColumn("piece", F.substr("text", begin.cast("int"), F.lit(spec.piece_chars))).drop("text")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "piece"))
    return marked.withColumn("rank", first).where(F.col("rank") <= spec.pieces).select("lang", "rank", "piece").collect()


def learn(df: DataFrame, spec: Languages = Languages()) -> dict[str, bytes]:
    """Dictionary contents by language from ``doc_id, text, lang``, the language with most documents first: pieces of the
    documents with the smallest hashes of ids.

    Rows without a language or text are left out. Only the bounded sample of pieces comes to the driver.
    """
    known = df.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    found = {r["lang"]: r["count"] for r in counts.collect()}  # a row per language
    names = list(found)
    if not names:
        return {}
    spec = replace(spec, pieces=max(1, min(spec.pieces, spec.all_pieces // len(names))))
    # Draws are uniform, so of a language's n documents about ``slack`` times the wanted pieces are below this bound and get ranked.
    rows = _drawn(known, {lang: min(1.0, spec.slack * spec.pieces / n) for lang, n in found.items()}, spec)
    got = Counter(r["lang"] for r in rows)
    few = {lang: 1.0 for lang, n in found.items() if got[lang] < min(n, spec.pieces)}
    if few:
        rows = [r for r in rows if r["lang"] not in few] + _drawn(known, few, spec)
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["piece"].lower())
    return {lang: "\n".join(out[lang]).encode() for lang in names if lang in out}


@lru_cache(maxsize=2)
def _compressors(contents: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    made = []
    for _, content in contents:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def sizes(text: str, contents: tuple[tuple[str, bytes], ...], spec: Languages = Languages()) -> np.ndarray:
    """Compressed bytes of the whole text under each language's dictionary."""
    data = text.lower().encode()
    blocks = [data[i : i + spec.block] for i in range(0, len(data), spec.block)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in _compressors(contents, spec.level)], np.int64)


def decide(found: np.ndarray, spec: Languages = Languages()) -> tuple[int, float, bool]:
    """(place of the smallest, score, accepted); the first of equals wins."""
    best = int(found.argmin())
    others = np.delete(found, best)
    score = 1 / (1 + np.exp(-(others - found[best]) / spec.bytes_per_nat).sum())
    lead = (others.min() - found[best]) / others.min() if len(others) else 1.0
    return best, float(score), bool(lead >= spec.margin)


_RESULT = "lang_pred string, score double, accepted boolean"


def predict(contents: dict[str, bytes], text: Column, spec: Languages = Languages()) -> Column:
    """A struct ``lang_pred, score, accepted`` of a text column.

    Texts that are missing or have no letter are ``und``, score 0, rejected; so is everything when no language was learned. Equal
    texts get equal results. Of languages that tie the first learned one is taken.
    """
    table = tuple(contents.items())

    def predicted(column: pa.Array) -> pa.Array:
        rows = []
        for x in column.to_pylist():
            if not table or not x or not _LETTER.search(x):
                rows.append((UNKNOWN, 0.0, False))
                continue
            best, score, accepted = decide(sizes(x, table, spec), spec)
            rows.append((table[best][0], round(score, 6), accepted))
        names, scores, sure = zip(*rows) if rows else ((), (), ())
        kinds = ("lang_pred", pa.string(), names), ("score", pa.float64(), scores), ("accepted", pa.bool_(), sure)
        return pa.StructArray.from_arrays([pa.array(v, t) for _, t, v in kinds], [n for n, _, _ in kinds])

    return F.arrow_udf(predicted, _RESULT)(text)


FOLDS, HELD_OUT = 3, 1


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spec: Languages = Languages()) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score, accepted``; learned only from rows that are not held out.

    Repeated rows get equal results; an id that is missing is held out or not by the checksum of the empty string.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    contents = learn(rows.where(~held), spec)
    done = rows.select("doc_id", held.alias("held_out"), predict(contents, F.col("text"), spec).alias("found"))
    return done.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")
