"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of which only the whole has a label. Every passage of the text is encoded (shares of the
transitions between character classes, word lengths, repeats), a hidden layer embeds it, gated attention
weighs the embeddings of a bag, and a logistic layer scores their weighted sum. Weights of all layers are learned together from
document labels, on the driver, from a sample of labelled rows whose size is a parameter;
scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.common import groups, over_batches, remainder, texts_of, word_hashes
from sparkwatch.session import discard, stored

#: Words of a passage.
PASSAGE = 64
CLASSES = 16
N_FEATURES = CLASSES * CLASSES + 5


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint8)
    table[128:] = 14
    for n, chars in enumerate(["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!", "?'\"()-", "#*$%&", "|<>", "/\\=_+@"]):
        table[list(chars.encode())] = n
    return table


_CLASS = _class_table()


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, one row each, and the number of passages per text.

    A text without words is one passage of zeros.
    """
    parts, counts = [], []
    for i, j in groups(texts):
        joined = b"\n".join(texts[i:j])
        hashes, starts = word_hashes(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        cuts = np.searchsorted(starts, begins)
        n_words = np.diff(cuts)
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        bag = np.repeat(np.arange(j - i), n_passages)
        place = np.arange(len(bag)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
        first_word = cuts[:-1][bag] + place * PASSAGE
        # byte spans: a passage reaches to the next one's first word, the last to the end of its text
        begin = np.where(place == 0, begins[:-1][bag], starts[np.minimum(first_word, max(0, len(starts) - 1))] if len(starts) else 0)
        end = np.append(begin[1:], begins[-1])
        reach = np.append(starts[1:], 0)  # up to the next word, or the end of the text
        some = n_words > 0
        reach[cuts[1:][some] - 1] = begins[1:][some]
        last_word = np.minimum(first_word + PASSAGE, cuts[1:][bag])
        parts.append(_features(joined, hashes, begins[1:-1] - 1, begin, end, first_word, last_word, reach[: len(starts)] - starts))
        counts.append(n_passages)
    if not parts:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def _features(joined: bytes, hashes, seams, begin, end, first, last, widths) -> np.ndarray:
    n, m = len(begin), CLASSES * CLASSES
    kinds = _CLASS[np.frombuffer(joined + b"\n", np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(n), end - begin)[: len(kinds) - 1]
    steps = owner * m + kinds[:-1] * CLASSES + kinds[1:]
    table = np.bincount(np.delete(steps, seams), minlength=n * m).reshape(n, m).astype(np.float32)
    n_words = (last - first).astype(np.float32)
    table[n_words == 0] = 0
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :m] = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    if len(hashes):
        word_owner = np.repeat(np.arange(n), last - first)
        keyed = np.sort((word_owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.concatenate(([True], keyed[1:] != keyed[:-1]))
        distinct = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
        again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])))
        some = np.maximum(1, n_words)
        out[:, m] = np.log1p(n_words) / 4
        out[:, m + 1] = np.minimum((end - begin) / some, 40) / 10 * (n_words > 0)
        out[:, m + 2] = distinct / some
        out[:, m + 3] = np.bincount(word_owner[again], minlength=n) / some
        out[:, m + 4] = np.bincount(word_owner[widths > 13], minlength=n) / some
    return out


@dataclass
class AttentionModel:
    """Weights of the embedding, the gated attention and the logistic layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-_forward(self.weights, (features - self.mean) / self.scale, counts)["logit"]))


@dataclass
class ConstantModel:
    """Where labels of both kinds are not to be had: the share of good ones, or a half."""

    value: float

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.value)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict:
    at = np.cumsum(counts) - counts
    h = np.tanh(x @ w["embed"] + w["embed_bias"])
    a, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    e = (a * g) @ w["pick"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
    alpha = e / np.repeat(np.add.reduceat(e, at), counts)
    z = np.add.reduceat(h * alpha[:, None], at)
    return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "at": at, "logit": z @ w["score"] + w["bias"]}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, counts)
    d_logit = (1 / (1 + np.exp(-f["logit"])) - label) / len(label)
    d_z = np.repeat(d_logit[:, None] * w["score"], counts, axis=0)
    d_alpha = (d_z * f["h"]).sum(1)
    d_e = f["alpha"] * (d_alpha - np.repeat(np.add.reduceat(f["alpha"] * d_alpha, f["at"]), counts))
    d_ag = d_e[:, None] * w["pick"]
    d_a, d_g = d_ag * f["g"] * (1 - f["a"] ** 2), d_ag * f["a"] * f["g"] * (1 - f["g"])
    d_h = d_z * f["alpha"][:, None] + d_a @ w["attend"].T + d_g @ w["gate"].T
    d_h *= 1 - f["h"] ** 2
    return {
        "embed": x.T @ d_h,
        "embed_bias": d_h.sum(0),
        "attend": f["h"].T @ d_a,
        "gate": f["h"].T @ d_g,
        "pick": (f["a"] * f["g"]).T @ d_e,
        "score": f["z"].T @ d_logit,
        "bias": d_logit.sum(),
    }


@dataclass(frozen=True)
class Training:
    """The sample that is learned from: at most ``documents`` labelled ones, in the order of their hashes as far as all their passages together
    are at most ``passages``. A document is in it with all its passages or, if it alone has more than a 16th of them, not at all."""

    documents: int = 4096
    passages: int = 1 << 17
    hidden: int = 24
    attention: int = 16
    epochs: int = 25
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 3


def fit(features: np.ndarray, counts: np.ndarray, label: np.ndarray, spec: Training = Training()):
    """Adam on the log loss of document labels."""
    if len(set(label.tolist())) < 2:
        return ConstantModel(float(label.mean()) if len(label) else 0.5)
    mean, scale = features.mean(0), features.std(0) + 0.05
    x = ((features - mean) / scale).astype(np.float32)
    draw = np.random.default_rng(spec.seed)
    shape = {"embed": (N_FEATURES, spec.hidden), "embed_bias": (spec.hidden,), "attend": (spec.hidden, spec.attention), "gate": (spec.hidden, spec.attention), "pick": (spec.attention,), "score": (spec.hidden,), "bias": ()}
    w = {k: (draw.normal(0, 1 / np.sqrt(max(1, (s or (1,))[0])), s) if "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    at = np.cumsum(counts) - counts
    step = 0
    for epoch in range(spec.epochs):
        order = draw.permutation(len(counts))
        rate = spec.rate * (1 - epoch / spec.epochs)
        for start in range(0, len(order), spec.batch):
            bags = order[start : start + spec.batch]
            rows = np.concatenate([np.arange(at[b], at[b] + counts[b]) for b in bags])
            grads = _gradients(w, x[rows], counts[bags], label[bags].astype(np.float32))
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                w[k] = (w[k] - rate * (move + spec.decay * w[k])).astype(np.float32)
    return AttentionModel(mean.astype(np.float32), scale.astype(np.float32), w)


def learn(df: DataFrame, labels: DataFrame, spec: Training = Training()):
    """A model from ``doc_id, text`` and ``doc_id, label``.

    Labels that are missing or neither 0 nor 1 are left out; of several for one id the lowest counts. The sample is that of the smallest
    hashes of the ids, whatever order the rows come in.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(spec.seed), "doc_id"), "doc_id").limit(spec.documents)
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``documents`` rows of two numbers

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        features, counts = encode_passages([t.encode() for t in texts_of(batch.column("text"))])
        ends = np.cumsum(counts)
        blobs = []
        for end, n in zip(ends, counts):
            blobs.append(features[end - n : end].tobytes())
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "n", "x"])

    every = stored(over_batches(rows, encoded, "doc_id long, label double, n long, x binary"))
    # at most ``documents`` ids; rows that share one are one document
    sizes = every.groupBy("doc_id").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64(F.lit(spec.seed), "doc_id"), "doc_id"))
    fits = sizes.where(F.col("n") <= spec.passages // 16).withColumn("upto", upto).where(F.col("upto") <= spec.passages).select("doc_id")
    # bounded by the sample: passages x features
    got = every.join(fits, "doc_id").drop("n").toPandas().sort_values(["doc_id", "x"], kind="stable")
    discard(every)
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    features = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return fit(features, np.array([len(b) for b in bags], np.int64), got["label"].to_numpy(), spec)


def score(model, text: Column) -> Column:
    """Score of a text column, 0 to 1; a missing text is scored like an empty one."""

    def scored(column: pa.Array) -> pa.Array:
        texts = [t.encode() for t in texts_of(column)]
        # a group of texts at a time, so that features of a whole batch are never held
        made = [model.scores(*encode_passages(texts[i:j])) for i, j in groups(texts)]
        return pa.array(np.round(np.concatenate([np.zeros(0), *made]), 6))

    return F.arrow_udf(scored, "double")(text)


#: Documents below this score are of low quality.
THRESHOLD = 0.3
FOLDS = 5


def report(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", spec: Training = Training()) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``; labels are learned only from rows that are not held out.

    Repeated rows get equal scores; an id that is missing is held out or not by the checksum of the empty string, and has no label.
    Texts that are missing or empty are bags of one passage of zeros. Without labels of both kinds all scores are their mean, or 0.5.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = remainder(F.col("doc_id"), FOLDS) == 0
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("label")).where(~held)
    model = learn(rows, known, spec)
    scored = rows.select("doc_id", held.alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", spec: Training = Training()) -> DataFrame:
    """The rows of ``df`` that are not of low quality, all columns unchanged."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("label"))
    model = learn(rows, known.where(remainder(F.col("doc_id"), FOLDS) != 0), spec)
    return df.where(score(model, F.col(text)) >= THRESHOLD)
