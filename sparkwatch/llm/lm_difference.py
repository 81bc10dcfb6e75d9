"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary, all words of all documents, and over one list of bigrams, all that occur. They are
smoothed alike, and the background's counts are scaled to the target's number of tokens, so that the two
differ in what they have seen and not in how much. A document's score is the mean, over its tokens, of what the
background model loses more than the target model.

Documents are packed into groups of a bounded number of bytes. A group counts its words and bigrams, each with what the target has
of it, and sends every part of the key space its keys in order, as packed differences. A part adds up the counts of all groups and
sends back totals alone, in the order of the keys that came; the group meets them when it reads its texts again. So a key is sent once
per group, however frequent it is, and neither its history nor its word goes along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparkwatch.llm.common import mix, texts_of, words_by_text
from sparkwatch.session import stored

REST, BEGIN = 0, 1
_HELD = 1 << 21
#: Bytes of text that make a group, and for which there is a part of the key space: about two million words of prose.
_GROUP_BYTES = 12 << 20
#: Texts of a group that are Python strings at a time, and tokens that are worked on at a time.
_TEXTS, _TOKENS = 64, 1 << 17


@dataclass(frozen=True)
class BigramModels:
    """Both models are made of all words and bigrams, or only of the ``words`` and ``bigrams`` most frequent ones of all documents."""

    words: int | None = None
    bigrams: int | None = None
    #: Weight of the word distribution against what a history was followed by, in tokens.
    prior: float = 50.0
    #: Without effect: no bigram is sent to the executors, as none is a hot key.
    sent: int = 1 << 18


def _lowered(column) -> list[bytes]:
    return [t.encode().lower() for t in texts_of(column)]


class Vocabulary:
    """Symbols of words: their hashes, or 0 for a word that is not among the listed ones. 1 is the beginning of a text."""

    def __init__(self, hashes: np.ndarray | None):
        self.hashes = None if hashes is None else np.sort(hashes.astype(np.int64))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        signed = words.view(np.int64)
        if self.hashes is None:
            return signed
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, signed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == signed, signed, REST)

    def bigrams(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and word of each token's bigram; ``sizes`` are the numbers of words of the texts."""
        word = self.symbols(words).view(np.uint64)
        key = np.roll(word, 1)
        key[(np.cumsum(sizes) - sizes)[sizes > 0]] = BEGIN
        for i in range(0, len(key), _TOKENS):
            j = i + _TOKENS
            key[i:j] = mix(mix(key[i:j]) + word[i:j])
        return key, word


def _tally(rows: DataFrame, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``key, n``: how often each key occurs. A task merges its keys before it gives them out, in bounded memory."""

    def merged(held: list[np.ndarray], waiting: list[np.ndarray]) -> list[np.ndarray]:
        every = np.concatenate((held[0], *waiting))
        found, at = np.unique(every, return_inverse=True)
        n = np.concatenate((held[1], np.ones(len(every) - len(held[0]), np.int64)))
        return [found, np.bincount(at, n, len(found)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, np.int64)] * 2
        waiting: list[np.ndarray] = []
        held, size = nothing, 0
        for batch in batches:
            for _, words in words_by_text(_lowered(batch.column("text"))):
                waiting.append(keys(words))
                size += len(words)
                if size >= _HELD:
                    held = merged(held, waiting)
                    waiting, size = [], 0
                    if len(held[0]) >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "n"])
                        held = nothing
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held, waiting)], ["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long")


def _most_frequent(rows: DataFrame, keys: Callable[[np.ndarray], np.ndarray], limit: int) -> np.ndarray:
    counts = _tally(rows, keys).groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "key").limit(limit).toPandas()["key"].to_numpy(np.int64))


# --- what is sent ---------------------------------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte: first the lowest of each, then the next."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of the key space begin and end in ``keys``, which are in order."""
    between = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, between), [len(keys)]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there. ``keys`` are sorted in place."""
    keys.sort()
    starts = np.flatnonzero(_first(keys))
    return keys[starts], np.diff(starts, append=len(keys))


def _first(keys: np.ndarray) -> np.ndarray:
    """Which of the keys, which are in order, are not equal to the one before."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _first(keys)
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    return keys[first], at


def _placed(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each of ``found`` is among ``keys``, which are sorted in place."""
    out = np.zeros(len(found), np.int64)
    some, n = _counted(keys)
    out[np.searchsorted(found, some)] = n
    return out


_GROUP = "group long, bytes long, ids array<long>, texts binary"
_ASKED = "group long, kind int, part int, n int, keys binary, counts binary"
_TOLD = "group long, kind int, part int, n int, totals binary, target long, background long, distinct long"
_BIGRAMS, _WORDS = 0, 1
#: Numbers per key: of target and background; words have them as words and as histories.
_WIDE = {_BIGRAMS: 2, _WORDS: 4}


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of ``doc_id, text`` in groups, each row once; a long text is a group of its own."""

    def made(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        text = whole.select(["text"])
        with pa.ipc.new_stream(sink, text.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(text.combine_chunks())
        return _table([(whole.column("row")[0].as_py(), size, whole.column("doc_id").to_pylist(), sink.getvalue().to_pybytes())], _GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")], np.int64)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > _GROUP_BYTES:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield made(held, size)
                    held, size, start = [], 0, i
                size += n
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield made(held, size)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, _GROUP)


def _words(texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a group, and the number of words of each text. Only a few texts at a time are Python strings."""
    column = pa.ipc.open_stream(texts).read_all().column("text")
    found, sizes = [np.zeros(0, np.uint64)], []
    for i in range(0, len(column), _TEXTS):
        some = [words for _, words in words_by_text(_lowered(column.slice(i, _TEXTS)))]
        sizes += map(len, some)
        found.append(np.concatenate(some))
    return np.concatenate(found), np.array(sizes, np.int64)


def asked(groups: DataFrame, parts: int, shared) -> DataFrame:
    """What the groups have of each part of the key space: keys in order, as differences, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a group at a time
                group, aimed, texts = (batch.column(c)[i].as_py() for c in ("group", "aimed", "texts"))
                words, sizes = _words(texts)
                chosen = np.zeros(len(sizes), bool)
                chosen[aimed or []] = True
                made = list(sent(group, words, sizes, chosen))
                del words
                yield _table(made, _ASKED)

    def sent(group: int, words: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> Iterator[tuple]:
        if not len(words):
            return
        bigram, word = shared.value[0].bigrams(words, sizes)
        inside = np.repeat(chosen, sizes)
        aimed = bigram[inside]
        found, n = _counted(bigram)
        del bigram
        yield from by_part(group, _BIGRAMS, found, [_placed(found, aimed), n])
        del aimed, n
        # every word but the last of a text is a history
        last, some = np.cumsum(sizes) - 1, sizes > 0
        found = _counted(np.append(word, np.uint64(BEGIN)))[0]
        counts = [_placed(found, word[inside]), _placed(found, word.copy())]
        for n, those in zip(tuple(counts), (some & chosen, some)):
            history = n - _placed(found, word[last[those]])
            history[np.searchsorted(found, np.uint64(BEGIN))] += those.sum()
            counts.append(history)
        yield from by_part(group, _WORDS, found, counts)

    def by_part(group: int, kind: int, keys: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple]:
        cuts = _cuts(keys, parts)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[part], cuts[part + 1]
            steps = np.diff(keys[i:j], prepend=np.uint64(0))
            yield group, kind, part, int(j - i), packed(steps), packed(np.concatenate([c[i:j] for c in counts]))

    return groups.select("group", "aimed", "texts").mapInArrow(run, _ASKED)


def told(asks: DataFrame) -> DataFrame:
    """Totals of a part's keys for each group that asked, in the order of its keys, and a row without a group with sums over the part."""

    def run(table: pa.Table) -> pa.Table:
        kind, part = (table.column(c)[0].as_py() for c in ("kind", "part"))
        groups, sizes = (table.column(c).to_pylist() for c in ("group", "n"))
        wide, ends = _WIDE[kind], np.cumsum(sizes)
        keys = np.empty(ends[-1], np.uint64)
        for n, end, data in zip(sizes, ends, table.column("keys")):
            np.cumsum(unpacked(data.as_py(), n), out=keys[end - n : end])
        found = _counted(keys.copy())[0]
        at = np.empty(len(keys), np.int32)
        totals = np.zeros((wide, len(found)), np.uint64)
        for n, end, data in zip(sizes, ends, table.column("counts")):
            own = at[end - n : end]
            own[:] = np.searchsorted(found, keys[end - n : end])
            for total, count in zip(totals, unpacked(data.as_py(), wide * n).reshape(wide, -1)):
                total[own] += count  # a group's keys are distinct
        del keys
        out = [(None, kind, part, len(found), None, int(totals[0].sum()), int(totals[1].sum()), int((totals[1] > 0).sum()))]
        for group, n, end in zip(groups, sizes, ends):
            out.append((group, kind, part, n, packed(totals[:, at[end - n : end]].ravel()), None, None, None))
        return pa.Table.from_batches([_table(out, _TOLD)])

    return asks.groupBy("kind", "part").applyInArrow(run, _TOLD)


_SUMS = "doc_id long, n_tokens long, loss_target double, loss_background double"


def score(df: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: BigramModels = BigramModels()) -> DataFrame:
    """Per document: ``doc_id, n_tokens, loss_target, loss_background`` (nats per token) and their ``difference``, background minus
    target: the higher, the more a document is like the target.

    A-Z are lower-cased; tokens stand between ASCII white space. Texts without tokens have NULL losses; so have all texts where the target
    has no tokens. Repeated rows count as often as they stand there. Other columns are not read.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = target_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    vocabulary, listed = Vocabulary(None), None
    if spec.words is not None:
        vocabulary = Vocabulary(_most_frequent(rows, lambda words: words.view(np.int64), spec.words))
    if spec.bigrams is not None:
        known = vocabulary
        listed = _most_frequent(rows, lambda words: known.bigrams(words, np.array([len(words)]))[0].view(np.int64), spec.bigrams)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, listed))

    groups = stored(grouped(rows))
    parts = -(-(groups.agg(F.sum("bytes")).first()[0] or 1) // _GROUP_BYTES)
    places = groups.select("group", F.posexplode("ids").alias("pos", "doc_id")).join(ids, "doc_id", "left_semi")
    # at most a group's texts
    aimed = stored(places.groupBy("group").agg(F.collect_list("pos").alias("aimed")))
    answers = stored(told(asked(groups.join(aimed, "group", "left"), parts, shared)))

    of = {r["kind"]: r for r in answers.where("group IS NULL").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("target", "background", "distinct")]).collect()}
    total = {side: of[_BIGRAMS][side] if of else 0 for side in ("target", "background")}
    # the listed words, or all, and entries for the rest and the beginning
    n_words = len(vocabulary.hashes) if vocabulary.hashes is not None else of[_WORDS]["distinct"] if of else 0
    size = n_words + 2
    scale = {"target": 1.0, "background": total["target"] / total["background"] if total["background"] else 1.0}

    def totals(answer: pa.Table, kind: int) -> np.ndarray:
        """All totals of a kind, in the order of the keys."""
        mine = answer.filter(pc.equal(answer.column("kind"), kind)).sort_by("part")
        sizes = mine.column("n").to_pylist()
        out, start = np.empty((_WIDE[kind], sum(sizes))), 0
        for n, data in zip(sizes, mine.column("totals")):
            out[:, start : start + n] = unpacked(data.as_py(), _WIDE[kind] * n).reshape(_WIDE[kind], -1)
            start += n
        return out

    def losses(texts: bytes, answer: pa.Table) -> tuple[np.ndarray, list]:
        """The number of tokens of each text, and what either model loses at them."""
        words, sizes = _words(texts)
        if not model_known or not len(words):
            return sizes, [[None] * len(sizes)] * 2
        bigram, word = shared.value[0].bigrams(words, sizes)
        word_at = _ranked(np.append(word, np.uint64(BEGIN)))[1]
        del words, word
        word_at, begin = word_at[:-1], word_at[-1]
        before = np.roll(word_at, 1)
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = begin
        keys, at = _ranked(bigram)
        del bigram
        unlisted = None if shared.value[1] is None else ~np.isin(keys.view(np.int64), shared.value[1])
        del keys
        bigrams, single = totals(answer, _BIGRAMS), totals(answer, _WORDS)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        sums = []
        for k, side in enumerate(("target", "background")):
            seen = np.multiply(bigrams[k], scale[side], out=bigrams[k])
            if unlisted is not None:
                seen[unlisted] = 0.0
            likely = spec.prior * ((single[k] * scale[side] + 1) / (float(total[side]) * scale[side] + size))
            history = single[2 + k] * scale[side] + spec.prior
            lost = np.empty(len(at))
            for i in range(0, len(at), _TOKENS):
                j = i + _TOKENS
                lost[i:j] = -np.log((seen[at[i:j]] + likely[word_at[i:j]]) / history[before[i:j]])
            sums.append(np.bincount(text_of, lost, len(sizes)))
        return sizes, sums

    def scored(group: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for row in group.to_pylist():
            sizes, sums = losses(row["texts"], answer)
            columns = [pa.array(x, kind) for x, kind in zip((row["ids"], sizes, *sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            out.append(pa.RecordBatch.from_arrays(columns, _fields(_SUMS)))
        return pa.Table.from_batches(out)

    model_known = total["target"] > 0
    asking = groups.select("group", "ids", "texts").groupBy("group")
    sums = asking.cogroup(answers.where("group IS NOT NULL").select("group", "kind", "part", "n", "totals").groupBy("group")).applyInArrow(scored, _SUMS)
    mean = {c: F.round(F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")), 9).alias(c) for c in ("loss_target", "loss_background")}
    out = sums.select("doc_id", "n_tokens", *mean.values())
    return out.withColumn("difference", F.round(F.col("loss_background") - F.col("loss_target"), 9))
