"""Quality rules: plain counts of a text, and bands of its n-gram perplexity.

Modified Kneser-Ney models of bytes, one for each language, are counted over all
documents and stay partitioned (``ngrams``).  A text's score is the mean negative
log probability (log perplexity) of its n-grams.  For each language the median
and the quartiles of the score over all documents set a lower and an upper limit;
shorter texts get wider bands, as their means vary more.  A language always has
its own median; its spread is the mean of its own and that of all languages,
weighted by its documents and ``LEAST_DOCS``.

Defined results: null and empty texts have no words, fail the base rules and
have a null score; a null language is a language of its own; repeated rows give
repeated rows, also of a null key; an empty table gives no rows.  Key, text and
language alone are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, words
from .common import checkpointed

#: Half widths of a band, in standard deviations estimated from the quartiles.
WIDTH = 4.0
LEAST_SIGMA = 0.01
#: Weight of the spread of all languages in a language's, in documents.
LEAST_DOCS = 100
SPREADS = ("below", "above")
QUARTILE = 0.6745
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    w = words.Words(data, offs)
    n = len(offs) - 1

    def inside(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return run

    chars = inside(((data & 0xC0) != 0x80) & ~words._SPACE[data])
    symbols = inside(SYMBOL[data])
    out = {"n_words": np.diff(w.first), "word_chars": np.diff(chars[offs]), "n_symbols": np.diff(symbols[offs])}

    # lines: runs between line feeds and text ends
    feeds = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offs, start, side="right") - 1
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(data) else end
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[has_word], end[has_word], row[has_word]
    dup = np.zeros(n, np.int64)
    if len(start):
        h = words.span_hashes(data, start, end)
        key = words.mix(h ^ words.mix(row.astype(np.uint64)))
        first = np.unique(key, return_index=True)[1]
        dup = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)
    out["n_dup_lines"] = dup

    g, at = words.grams(w.hashes(), w.doc, WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(g):
        key = words.mix(g ^ words.mix(w.doc[at].astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.append(same, False) | np.insert(same, 0, False)
        mark = np.zeros(len(w.start) + WINDOW, np.int32)
        hit = at[order[twice]]
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + WINDOW, -1)
        run = inside(np.cumsum(mark)[: len(w.start)] > 0)
        repeat = np.diff(run[w.first])
    out["n_repeat_words"] = repeat
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limits: ngrams.Limits = ngrams.Limits()) -> DataFrame:
    """(key, lang, the counts, n_grams, log_perplexity) of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = docs.schema[key].dataType
    names = ["key", "lang", *COUNTS, "n_grams", "log_perplexity"]
    schema = f"key {kind.simpleString()}, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", n_grams bigint, log_perplexity double"
    none = docs.sparkSession.createDataFrame([], schema).toArrow()

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        done = []
        for part, n, value in ngrams.means(ngrams.opened(table), *ngrams.replied(replies), limits):
            counts = base_counts(*words.buffers(part.column(1)))
            done.append(pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(n), pa.array(value, mask=n == 0)], names=names))
        return pa.Table.from_batches(done) if done else none

    texts, replies = ngrams.exchanged(rows, limits)
    done = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(last, schema)
    return done.withColumnRenamed("key", key)


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: the counts, base_failed, kept, the log perplexity and
    the limits of its band."""
    scored = checkpointed(score(docs, key, text, lang))
    x = F.col("log_perplexity")

    def sums(rows):
        q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
        return rows.agg(q(x).alias("q"), F.percentile_approx("n_grams", 0.5).alias("n_mid"), F.count(x).alias("n_docs"))

    named = F.coalesce(F.col("lang"), F.lit("\0"))
    bands = sums(scored.groupBy(named.alias("band")))
    bands = bands.select(
        "band",
        "n_docs",
        "n_mid",
        F.col("q")[1].alias("mid"),
        *(F.coalesce(c / QUARTILE, F.lit(0.0)).alias(f"own_{name}") for name, c in (("below", F.col("q")[1] - F.col("q")[0]), ("above", F.col("q")[2] - F.col("q")[1]))),
    )
    # spreads inside the languages, a mean over all documents
    spreads = bands.agg(*((F.sum(F.col("n_docs") * F.col(f"own_{c}")) / F.greatest(F.sum("n_docs"), F.lit(1))).alias(f"all_{c}") for c in SPREADS))
    shrunk = lambda c: F.greatest((F.col("n_docs") * F.col(f"own_{c}") + LEAST_DOCS * F.col(f"all_{c}")) / (F.col("n_docs") + LEAST_DOCS), F.lit(LEAST_SIGMA))
    bands = bands.crossJoin(F.broadcast(spreads)).select("band", "mid", "n_mid", *(shrunk(c).alias(c) for c in SPREADS))
    salts = 32  # a language may hold most rows
    bands = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = scored.withColumns({"band": named, "salt": F.pmod(F.xxhash64(key, "log_perplexity"), F.lit(salts)).cast("int")}).join(bands, ["band", "salt"], "left")
    wide = lambda mid, n: WIDTH * F.sqrt(F.greatest(F.lit(1.0), F.col(mid) / F.greatest(F.col(n), F.lit(1))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    low, high = F.col("mid") - wide("n_mid", "n_grams") * F.col("below"), F.col("mid") + wide("n_mid", "n_grams") * F.col("above")
    inside = F.coalesce(x.between(low, high), F.lit(True))
    return joined.select(key, *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", "log_perplexity", low.alias("lower"), high.alias("upper"))
