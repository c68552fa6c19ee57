"""I-Match document fingerprints, in DataFrame functions only.

A text's terms are its lower-cased words.  Document frequencies are counted over
all documents for each term (64-bit hash).  The lexicon is the terms whose
inverse document frequency lies in a band; as both ends of the band are shares
of the documents (the lower one ``LEAST_DOCS`` documents at least), it has at
most the mean number of distinct terms of a text divided by ``LEAST_SHARE``
terms, however large the vocabulary is.  The distinct terms in the lexicon are sorted
and hashed once whole and once for each randomised lexicon subset: for each scale
of ``SCALES``, ``SUBSETS`` disjoint ones that keep one in so many terms.  Large
subsets only agree on equal texts, small ones also on texts that differ in places,
whatever their length; the likeness of two fingerprints is the share of agreeing
parts among those that are not empty in both.

Defined results: a null text counts as empty; texts without lexicon terms have
the empty fingerprint, and two empty fingerprints have likeness 1; repeated rows
give repeated rows; keys may be of any type that Spark can order, and null keys
come after all others.  Key and text alone are read, so other columns' names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Lexicon: terms that occur in at most this share of the documents, and in at
#: least this many and this share of them.
MOST_SHARE, LEAST_DOCS = 0.1, 2
LEAST_SHARE = 1e-3
SCALES = (16, 64, 256, 1024, 4096)
SUBSETS = 6
#: Neighbouring documents that are sorted together, and blocks at most; what
#: their bounds take on the driver and in the plan is bounded by the latter.
BLOCK_ROWS, MOST_BLOCKS = 2000, 4096


def _terms(text: Column) -> Column:
    """Distinct hashes of the lower-cased words."""
    listed = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(listed, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The hashes of the lexicon's terms."""
    n = docs.count()
    df = docs.select(F.explode(_terms(F.col(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    least = max(min(LEAST_DOCS, max(n, 1)), math.ceil(LEAST_SHARE * n))
    kept = df.where((F.col("df") >= least) & (idf >= math.log(1 / MOST_SHARE)))
    return kept.select("h").toArrow().column("h").to_numpy()


def _literal(values: np.ndarray, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")  # folded to one literal


def _place(scale: int, h: Column) -> Column:
    return F.xxhash64(F.lit(scale), h).bitwiseAND(F.lit(scale - 1))


def table(spark: SparkSession, held: np.ndarray) -> tuple[DataFrame, int]:
    """The terms of a lexicon as a hash table of about four terms a place, by
    their low bits: a frame of one row and column, and the number of places."""
    size = 1 << max(0, len(held).bit_length() - 2)
    low = held & (size - 1)
    start = np.searchsorted(np.sort(low), np.arange(size + 1)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(start), pa.array(held[np.argsort(low, kind="stable")], pa.int64()))
    whole = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), places)
    return checkpointed(spark.createDataFrame(pa.table([whole], names=["places"]))), size


def fingerprint(rows: DataFrame, text: str, held: np.ndarray | tuple[DataFrame, int], out: str) -> DataFrame:
    """Adds ``out``: the parts of each text's fingerprint, null where empty.
    held: the lexicon, or its ``table``."""
    one, size = held if isinstance(held, tuple) else table(rows.sparkSession, held)
    # the table is a subquery's value: tasks get it once, and neither rows nor the
    # plan's descriptions, which the driver keeps, hold its terms.  It is named but
    # once, and beside it only what is named once too, so that Spark puts the
    # subquery in place of the column
    all_, places = f"{out}_terms", f"{out}_places"
    rows = rows.withColumns({all_: _terms(F.coalesce(F.col(text), F.lit(""))), places: one.scalar()})

    def inside(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(size - 1)).cast("int") + 1
        return F.array_contains(F.element_at(F.col(places), at), h)

    rows, columns = rows.withColumn(all_, F.array_sort(F.filter(all_, inside))).drop(places), [all_]
    parts = [F.when(F.size(all_) > 0, F.xxhash64(F.col(all_)))]
    for scale in SCALES:
        name = f"{out}_{scale}"  # the terms of this scale's subsets, each hashed once
        rows = rows.withColumn(name, F.filter(all_, lambda h: _place(scale, h) < SUBSETS))
        columns.append(name)
        for j in range(SUBSETS):
            chosen = F.filter(name, lambda h: _place(scale, h) == j)
            parts.append(F.when(F.exists(name, lambda h: _place(scale, h) == j), F.xxhash64(chosen)))
    parts = F.array(*parts)
    return rows.withColumn(out, parts).drop(*columns)


def shown(parts: Column) -> Column:
    """A fingerprint as text: 16 hex digits a part, ``-`` for an empty one."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.lpad(F.lower(F.hex(p)), 16, "0"), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty in both, 0 to 1."""
    total = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda z: z.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when(total == 0, F.lit(1.0)).otherwise(same / total)


def _bounds(rows: DataFrame, key: str, tie: Column) -> list[tuple]:
    """Upper ends (key, tie) of even parts of the rows that have a key."""
    held = rows.select(F.struct(F.col(key).alias("k"), tie.alias("h")).alias("p")).where("p.k is not null")
    parts = max(1, min(MOST_BLOCKS, held.count() // BLOCK_ROWS))
    ends = held.repartitionByRange(parts, "p").groupBy(F.spark_partition_id()).agg(F.max("p").alias("p")).orderBy("p")
    return [(r[0], r[1]) for r in ends.select("p.k", "p.h").collect()]


def _block(rows: DataFrame, key: str, tie: Column) -> Column:
    """The number of bounds below a row's place, found in two steps, -1 for a
    null key; the bounds are literals of the plan."""
    ends = _bounds(rows, key, tie)
    if not ends:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(0).cast("bigint")
    kind = rows.schema[key].dataType.simpleString()
    step = math.isqrt(len(ends))

    def below(chosen: list[tuple], first: Column | None = None) -> Column:
        keys = F.array(*(F.lit(k) for k, _ in chosen)).cast(f"array<{kind}>")
        ties = _literal(np.array([h for _, h in chosen]), "bigint")
        at = F.lit(0) if first is None else first
        held = keys if first is None else F.slice(keys, first + 1, F.lit(step))
        less = lambda k, i: (k < F.col(key)) | ((k == F.col(key)) & (F.element_at(ties, at + i + 1) < tie))
        return F.size(F.filter(held, less))

    tops = ends[step - 1 :: step]
    first = below(tops) * step
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(first + below(ends, first)).cast("bigint")


def with_next(rows: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Adds the columns of the row with the next smaller key (the largest key's
    row for the smallest key).  Rows are sorted in at most ``MOST_BLOCKS`` blocks
    between sampled quantiles of their keys, of any type that Spark can order;
    only one row of each block takes its follower from another block.  Rows of
    equal keys are ordered by a hash of their first column, which also spreads
    them over blocks.  Rows with a null key come last."""
    rows = rows.withColumn("_tie", F.xxhash64(columns[0]))
    block = _block(rows, key, F.col("_tie"))
    order = Window.partitionBy("_block").orderBy(F.col(key).desc_nulls_last(), F.desc("_tie"), *columns)
    # every branch below reads the rows in the same order, so one exchange serves
    # all; a rank filter would get a plan, and a pass over the texts, of its own
    at = rows.withColumn("_block", block)
    for c in columns:
        at = at.withColumn(prefix + c, F.lead(c).over(order))
    at = at.withColumn("_more", F.lead(F.lit(True), 1, False).over(order)).withColumn("_head", ~F.lag(F.lit(True), 1, False).over(order))
    firsts = at.where("_head")
    heads = firsts.select(F.col("_block").alias("_next"), *(F.col(c).alias(prefix + c) for c in columns))
    # one row a block: which block follows
    following = Window.orderBy(F.col("_block").desc())
    blocks = firsts.select("_block")
    blocks = blocks.withColumn("_next", F.coalesce(F.lead("_block").over(following), F.max("_block").over(Window.partitionBy())))
    inner = at.where("_more").drop("_block", "_tie", "_more", "_head")
    last = at.where("not _more").drop(*(prefix + c for c in columns), "_tie", "_more", "_head")
    joined = last.join(blocks, "_block").join(heads, "_next").select(*inner.columns)
    return inner.unionByName(joined)


def query(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's, and likenesses."""
    held = table(docs.sparkSession, lexicon(docs, text))
    out, key, docs = key, "_key", docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprint(rows, "text", held, "parts"), key, ["text", "parts"])
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - _cut)"), F.expr("substring(next_text, 1, _cut)")))
    rows = fingerprint(rows.select(key, "n_chars", "edited", "parts", "next_parts"), "edited", held, "edited_parts")
    return rows.select(
        F.col(key).alias(out),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("parts")).alias("fingerprint"),
        shown(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
