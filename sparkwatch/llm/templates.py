"""Line dedup with a tree of log templates.

Every line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where tokens with digits count as a
variable field. Within a leaf the templates are generalised: at each position the token of the majority of lines stays, others become
a field. Lines that agree with that at enough positions belong to the template; the rest of the leaf goes
through the same once more. What remains then is split by its most informative position, and each part goes through the same, until
no part is left that could hold a recurring template. Lines whose template recurs in several documents are
dropped, except where it stands first.

The tree is a key, so leaves are groups of a shuffle. Leaves with too few lines or one document are out before any text moves, equal
lines are counted before their tokens are, and counts are added up per task before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.common import WORD, free_name, maybe_in
from sparkwatch.session import discard, stored

FIELD = "<*>"
_SPACE = "[\\x20\\x09-\\x0D]+"
_WITH_DIGIT = "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*"


@dataclass(frozen=True)
class Templates:
    depth: int = 3
    #: Lines with fewer tokens, and templates with fewer constant ones, are let be.
    tokens: int = 3
    constants: int = 2
    #: Share of positions at which a line must agree with its template.
    agree: float = 0.7
    #: Times a leaf is generalised before what remains of it is split.
    rounds: int = 2
    #: Documents in which a template must stand to be dropped from all but the first.
    documents: int = 5
    #: Places over which the lines of one template are spread.
    salts: int = 32


def leaves_of(df: DataFrame, spec: Templates = Templates()) -> DataFrame:
    """``doc_id, pos, raw, leaf`` of each line with enough tokens. Only the leading tokens are taken apart."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("n", F.regexp_count("raw", F.lit(WORD))).where(F.col("n") >= spec.tokens)
    # white space in front gives an empty first part, the last part is the rest of the line
    parts = F.slice(F.filter(F.split("raw", _SPACE, spec.depth + 2), lambda x: x != ""), 1, spec.depth)
    leading = F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))
    return lines.select("doc_id", "pos", "raw", F.xxhash64("n", leading).alias("leaf"))


def masked(raw: Column) -> Column:
    """A line with fields for tokens with digits, and single spaces."""
    tokens = F.filter(F.split(F.regexp_replace(raw, _WITH_DIGIT, FIELD), _SPACE), lambda x: x != "")
    return F.array_join(tokens, " ")


def generalised(counts: DataFrame) -> DataFrame:
    """``leaf, template`` from ``leaf, line, n``: the majority token of each position, a field where there is none."""
    places = counts.select("leaf", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    tokens = places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    most = tokens.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("m"), F.sum("n").alias("all"))
    token = F.when(F.col("m.n") * 2 > F.col("all"), F.col("m.token")).otherwise(F.lit(FIELD))
    # as many rows as a line has tokens
    parts = most.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", token.alias("token")))).alias("p"))
    return parts.select("leaf", F.transform("p", lambda x: x["token"]).alias("template"))


def fitted(left: DataFrame, spec: Templates) -> DataFrame:
    """``left`` with the ``template`` of its leaf and whether the line ``fits`` it."""
    pairs = left.join(generalised(left), "leaf").withColumn("w", F.split("line", " "))
    same = F.aggregate(F.zip_with("w", "template", lambda x, y: ((x == y) & (y != FIELD)).cast("int")), F.lit(0), lambda s, x: s + x)
    return stored(pairs.select(*left.columns, "template", (same >= F.size("w") * spec.agree).alias("fits")))


def split_by_position(left: DataFrame) -> DataFrame:
    """``left`` in finer leaves: by the token at that position which the next varying position tells most about.

    Words of a template go together, so the next one leaves little of their entropy; a variable field keeps most of its own. A leaf with one
    varying position is split by that.
    """
    places = left.select("leaf", "line", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    varying = places.groupBy("leaf", "at").agg(F.min("token").alias("a"), F.max("token").alias("b")).where("a != b")
    order = Window.partitionBy("leaf").orderBy("at")  # as many rows as a line has tokens
    varying = stored(varying.select("leaf", "at", F.lead("at").over(order).alias("next"), F.lag("at").over(order).alias("last")))
    known = left.join(varying, "leaf").withColumn("w", F.split("line", " "))
    token = F.get("w", F.col("at"))
    beside = F.explode(F.array_compact(F.array("next", "last")))
    lone = known.select("leaf", "n", "at", token.alias("token"), "w", F.coalesce("next", "last").isNull().alias("lone"), "next", "last")
    pairs = lone.select("leaf", "n", "at", "token", "w", beside.alias("other")).withColumn("seen", F.get("w", F.col("other")))
    logs = F.sum(F.col("n") * F.log2("n"))
    both = pairs.groupBy("leaf", "at", "other", "token", "seen").agg(F.sum("n").alias("n"))
    joint = both.groupBy("leaf", "at", "other").agg(logs.alias("joint"), F.sum("n").alias("all"))
    seen = both.groupBy("leaf", "at", "other", "seen").agg(F.sum("n").alias("n")).groupBy("leaf", "at", "other").agg(logs.alias("seen"))
    own = both.groupBy("leaf", "at", "other", "token").agg(F.sum("n").alias("n")).groupBy("leaf", "at", "other").agg(logs.alias("own"))
    scored = joint.join(seen, ["leaf", "at", "other"]).join(own, ["leaf", "at", "other"])
    entropy = F.col("all") * F.log2("all") - F.col("own")
    told = scored.select("leaf", "at", F.round((F.col("seen") - F.col("joint")) / entropy, 9).alias("rest"), F.round(entropy, 6).alias("entropy"))
    single = varying.where(F.coalesce("next", "last").isNull()).select("leaf", "at", F.lit(0.0).alias("rest"), F.lit(0.0).alias("entropy"))
    best = told.unionByName(single).groupBy("leaf").agg(F.min(F.struct("rest", "entropy", "at")).alias("b")).select("leaf", F.col("b.at").alias("at"))
    finer = F.xxhash64("leaf", "at", F.get(F.split("line", " "), F.col("at")))
    # a leaf of one line does not vary and needs no more
    return left.join(best, "leaf").select(finer.alias("leaf"), "root", "line", "n")


def templates(lines: DataFrame, spec: Templates = Templates()) -> DataFrame:
    """``leaf, line, template`` of the distinct lines."""
    every = stored(lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")))
    left = every.withColumn("root", F.col("leaf"))
    done = []
    while True:
        for _ in range(spec.rounds):
            tried = fitted(left, spec)
            done.append(tried.where("fits").select(F.col("root").alias("leaf"), "line", F.array_join("template", " ").alias("template")))
            left = tried.where(~F.col("fits")).drop("template", "fits")
        # fewer lines than documents make no recurring template
        large = left.groupBy("leaf").agg((F.sum("n") >= spec.documents).alias("large"), F.count(F.lit(1)).alias("k")).where("large AND k > 1").select("leaf")
        left = stored(left.join(large, "leaf", "left_semi"))
        if left.isEmpty():
            break
        left = stored(split_by_position(left))
    out = done[0] if done else every.select("leaf", "line", F.col("line").alias("template")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    # what has no template is one of its own
    rest = every.join(out, ["leaf", "line"], "left_anti").select("leaf", "line", F.col("line").alias("template"))
    return out.unionByName(rest)


def dropped_lines(df: DataFrame, spec: Templates = Templates()) -> DataFrame:
    """``doc_id, pos`` of the lines to drop, from ``doc_id, text``."""
    # lines are taken apart once; the table of them goes again before anything else is shuffled
    lines = stored(leaves_of(df, spec))
    several = (F.count(F.lit(1)) >= spec.documents) & (F.min("doc_id") != F.max("doc_id"))
    leaves = stored(lines.groupBy("leaf").agg(several.alias("several")).where("several").select("leaf"))
    kept = maybe_in(lines, "leaf", leaves).join(leaves, "leaf", "left_semi")
    kept = stored(kept.select("doc_id", "pos", masked(F.col("raw")).alias("line"), "leaf"))
    discard(lines)
    named = stored(templates(kept, spec))
    constants = F.size(F.filter(F.split("template", " "), lambda x: x != FIELD))
    placed = kept.join(named.where(constants >= spec.constants), ["leaf", "line"]).select("doc_id", "pos", "leaf", "template")
    # once per document, then over documents
    in_documents = placed.groupBy("leaf", "template", "doc_id").agg(F.min("pos").alias("pos"))
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    recurring = in_documents.where(F.col("doc_id").isNotNull()).groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("k"), first).where(F.col("k") >= spec.documents)
    # a template may hold a third of all lines: they meet it in as many places as there are salts
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(spec.salts)).cast("int").alias("salt")
    copies = recurring.select("*", F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))).alias("salt"))
    found = placed.select("*", salt).join(copies, ["leaf", "template", "salt"])
    return found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos"))).select("doc_id", "pos")


def drop_templates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_dropped: str = "n_dropped", spec: Templates = Templates()) -> DataFrame:
    """``df`` without the lines of recurring templates, and ``n_dropped``, how many lines went; all other columns stay.

    The first document (by id) with a template keeps the first such line. Lines are what stands between line feeds. A missing text stays missing; a
    text may become empty. Rows that share an id are one document; rows without an id are let be. Ties between tokens of a position
    cannot make a majority. A column called ``n_dropped`` is replaced.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own, lines = free_name(df, "_id_of_lines"), free_name(df, "_lines")
    drops = dropped_lines(rows, spec).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("pos").alias(lines))

    def cut(texts: pa.Array, drop: pa.Array) -> pa.Array:
        made = []
        for x, gone in zip(texts.to_pylist(), drop.to_pylist()):
            gone = set(gone or ())
            made.append(None if x is None else "\n".join(line for i, line in enumerate(x.split("\n")) if i not in gone))
        return pa.array(made, pa.string())

    joined = df.drop(n_dropped).join(drops, F.col(doc_id) == F.col(own), "left")
    touched = F.col(lines).isNotNull()
    changed = F.arrow_udf(cut, "string")(F.when(touched, F.col(text)), F.col(lines))
    out = joined.withColumn(text, F.when(touched, changed).otherwise(F.col(text)))
    out = out.withColumn(n_dropped, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    return out.select(*df.drop(n_dropped).columns, n_dropped)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Templates = Templates()) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_chars, kept_sha256`` of the text that is left (missing: empty)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    done = drop_templates(rows, spec=spec)
    left = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.greatest("n_lines", F.lit(0).cast("long")).alias("n_lines"), "n_dropped", F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"))
