"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities of lexicon entries (as written, and after undoing
common character swaps), how near second-person pronouns stand to them, rates of
capitals, punctuation and obfuscated words.  Lexicon entries are whole words and
word beginnings of ``BEGINNINGS`` code points, as inflected and compound words
share beginnings, in any language.  They are learned: an entry's weight is the
lower confidence bound of the log odds that a toxic row has it.  A word's weight
is that of its heaviest entry; a short list of plain insults weighs
``INSULT_WEIGHT`` at least.

Lexicon, trees and calibration are fitted on at most ``SAMPLE_ROWS`` labelled
rows (the smallest hashes of the key); nothing else is cut.  Rows are dealt to
``FOLDS`` by their text, and a row is measured for the fit with the entries of the
other folds; one fold calibrates, the others grow the trees.  Labels, languages,
sources and keys are no inputs of a score.

Defined results: null and empty texts score like a text without words; repeated
rows score alike; without labelled rows of both kinds all scores are the share
of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import checkpointed, smallest_hashes

SAMPLE_ROWS = 20_000
LIMIT = 0.3
NEAR = 4  # words between a pronoun and a lexicon word
BEGINNINGS = range(3, 9)
FOLDS = 4
#: An entry is learned from so many toxic rows at least, with this lower bound
#: (``CONFIDENCE`` standard deviations down) of its log odds.
LEAST_ROWS, LEAST_WEIGHT, CONFIDENCE = 3, 0.5, 1.64
INSULT_WEIGHT = 2.0
#: Weights from which a word counts in each density.
STEPS = (0.5, 1.5, 2.5, 3.5)

#: Plain insults, to which the words that labels show are added.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool garbage imbecile jerk filth vermin".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()

FEATURES = [
    *(f"{name}_{step}" for step in STEPS for name in ("hits", "hit_rate")),
    *("weight", "weight_rate", "heaviest", "swapped_rate", "distinct_hits", "near_rate", "near_hits", "person_rate"),
    *("capitals", "shouted", "punctuation", "exclaims", "obfuscated", "repeats", "word_length", "log_words"),
]

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_OPENS = _ALNUM.copy()
_OPENS[[ord("@"), ord("$")]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_PLAIN = words._LOWER.copy()
for _a, _b in zip(b"0134578@$!", b"oieastbasi"):  # character swaps that are undone
    _PLAIN[_a] = _b


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of Latin (its second block too) and Cyrillic capitals, byte by
    byte, so that no length changes."""
    low = words._LOWER[data]
    if len(data) > 1:
        lead, at = data[:-1], data[1:]
        low[1:] += ((lead == 0xC3) & (at >= 0x80) & (at <= 0x9E) & (at != 0x97)).astype(np.uint8) * np.uint8(0x20)
        cyrillic = (lead == 0xD0) & (at >= 0x90) & (at <= 0xAF)
        if cyrillic.any():
            second = cyrillic & (at >= 0xA0)
            low[1:][cyrillic & ~second] += np.uint8(0x20)
            low[1:][second] -= np.uint8(0x20)
            low[:-1][second] = 0xD1
    return low


def hashes_of(listed: list[str]) -> np.ndarray:
    data, offs = words.buffers(pa.array(listed or [""]))
    return np.unique(words.span_hashes(lowered(data), offs[:-1], offs[1:]))


class Lexicon:
    """Sorted hashes of entries and their weights, and those of pronouns."""

    def __init__(self, entry: np.ndarray, weight: np.ndarray):
        insults = words.mix(hashes_of(INSULTS))
        entry = np.concatenate([entry.astype(np.uint64), insults])
        weight = np.concatenate([weight, np.full(len(insults), INSULT_WEIGHT)])
        order = np.lexsort((-weight, entry))  # the heavier of two comes first
        self.entry, first = np.unique(entry[order], return_index=True)
        self.weight = weight[order][first]
        self.person = hashes_of(SECOND_PERSON)

    def weights(self, entry: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.entry, entry), len(self.entry) - 1)
        return np.where(self.entry[at] == entry, self.weight[at], 0.0)

    def heaviest(self, w: Stripped, data: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Weight of the heaviest entry of each of some words."""
        out = np.zeros(len(which))
        for at, entry in w.entries(data, which):
            out[at] = np.maximum(out[at], self.weights(entry))
        return out


class Stripped(words.Words):
    """Words without the marks around them; words of marks only stay whole."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        super().__init__(data, offs)
        self.data = lowered(data)
        n = len(data)
        if len(self.start):
            at = np.arange(n)
            following = np.minimum.accumulate(np.where(_OPENS[data], at, n)[::-1])[::-1]
            previous = np.maximum.accumulate(np.where(_ALNUM[data], at, -1))
            a, b = following[self.start], previous[self.end - 1] + 1
            good = (a < b) & (a < self.end) & (b > self.start)
            self.start, self.end = np.where(good, a, self.start), np.where(good, b, self.end)

    def entries(self, data: np.ndarray, which: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index among some words, entry hash) of whole words and each
        beginning, of the bytes ``data`` at the words' places."""
        start, end = self.start[which], self.end[which]
        every = np.arange(len(start))
        hashed = words.Spans(data)
        yield every, words.mix(hashed.of(start, end))
        before = words.code_points(data)
        place = np.append(np.flatnonzero(np.diff(before)), len(data))  # of each code point
        first, last = before[start], before[end]
        for k in BEGINNINGS:
            at = every[last - first >= k]
            yield at, hashed.of(start[at], place[first[at] + k])


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; float32."""
    w = Stripped(data, offs)
    n, total = len(offs) - 1, len(w.start)
    per = lambda x: np.bincount(w.doc, weights=x, minlength=n) if total else np.zeros(n)

    def run(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    of_text = lambda mask: np.diff(run(mask)[offs])
    of_word = lambda r: r[w.end] - r[w.start]
    h = w.hashes()
    undone = _PLAIN[w.data]
    _, first, of = np.unique(h, return_index=True, return_inverse=True)  # each distinct word is looked up once
    direct = lexicon.heaviest(w, w.data, first)[of]
    plain, swapped = direct.copy(), np.flatnonzero(of_word(run(undone != w.data)) > 0)
    plain[swapped] = lexicon.heaviest(w, undone, swapped)
    weight = np.maximum(direct, plain)
    hit = weight >= STEPS[1]
    size = np.diff(w.first)
    some = np.maximum(size, 1)
    second = lexicon.person[np.minimum(np.searchsorted(lexicon.person, h), len(lexicon.person) - 1)] == h
    reach = np.zeros(total, bool)
    at = np.flatnonzero(hit)
    for k in range(-NEAR, NEAR + 1):
        to = at + k
        to = to[(to >= 0) & (to < total)]
        reach[to] |= True
    near = reach & second
    letters, uppers = run(_LETTER[data]), run(_UPPER[data])
    in_letters, length = of_word(letters), w.end - w.start
    marks = run(_MARK[data])
    digits = length - in_letters
    odd = (in_letters > 1) & (digits > 0) & (in_letters >= digits)
    twice = np.zeros(total, bool)
    if total > 1:
        twice[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    spelled = words.span_hashes(undone, w.start[hit], w.end[hit]) >> np.uint64(1)
    pairs = np.unique(np.stack([w.doc[hit], spelled.astype(np.int64)], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
    most = np.zeros(n)
    np.maximum.at(most, w.doc, weight)
    text_letters = np.maximum(np.diff(letters[offs]), 1)
    size_bytes = np.maximum(np.diff(offs), 1)
    columns = [x for step in STEPS for count in [per(weight >= step)] for x in (count, count / some)] + [
        per(weight),
        per(weight) / some,
        most,
        per((plain >= STEPS[1]) & (direct < STEPS[1])) / some,
        np.bincount(pairs[:, 0], minlength=n),
        per(near) / np.maximum(per(second), 1),
        per(near),
        per(second) / some,
        np.diff(uppers[offs]) / text_letters,
        per((of_word(uppers) == in_letters) & (in_letters > 1)) / some,
        np.diff(marks[offs]) / size_bytes,
        of_text(data == 33) / some,
        per(odd) / some,
        per(twice) / some,
        per(length) / some,
        np.log1p(size),
    ]
    return np.stack(columns, 1).astype(np.float32)


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned
    features.  A tree of depth d is 2**d - 1 splits and 2**d values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, smooth: float = 5.0):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = np.log(p / (1 - p))
        f, width = np.full(len(y), self.base), x.shape[1]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat = b + np.arange(width) * bins
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins)
            for level in range(depth):
                first = (1 << level) - 1
                key = ((node - first)[:, None] * (width * bins) + flat).ravel()
                cells = (1 << level) * width * bins
                g = np.bincount(key, weights=np.repeat(grad, width), minlength=cells).reshape(-1, width, bins).cumsum(2)
                s = np.bincount(key, weights=np.repeat(hess, width), minlength=cells).reshape(-1, width, bins).cumsum(2)
                gt, st = g[:, :, -1:], s[:, :, -1:]
                gain = g**2 / (s + smooth) + (gt - g) ** 2 / (st - s + smooth) - gt**2 / (st + smooth)
                gain[:, :, -1] = 0
                best = gain.reshape(1 << level, -1).argmax(1)
                useful = gain.reshape(1 << level, -1).max(1) > 1e-6
                feature[first : first + (1 << level)] = np.where(useful, best // bins, 0)
                cut[first : first + (1 << level)] = np.where(useful, best % bins, bins)
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, weights=grad, minlength=1 << depth) / (np.bincount(leaf, weights=hess, minlength=1 << depth) + smooth)
            f += value[leaf]
            self.trees.append((feature, cut, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            f += value[node - ((1 << self.depth) - 1)]
        return f


class Isotonic:
    """Pool-adjacent-violators fit, linear between the pools' means; a
    thousandth of the uncalibrated probability keeps the order inside a pool."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # [sum of y, rows, sum of margins]
        for m, v in zip(margin[order], y[order]):
            pools.append([float(v), 1.0, float(m)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.at = np.array([p[2] / p[1] for p in pools])
        self.value = np.array([p[0] / p[1] for p in pools])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(margin, self.at, self.value) + 0.001 / (1 + np.exp(-margin))


class Model:
    """Lexicon, trees and calibration; ``score`` takes an Arrow part's bytes."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.trees: Boosted | None = None
        self.calibrate: Isotonic | None = None
        self.share = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Model:
        self.share = float(y.mean()) if len(y) else 0.0
        grow = ~calibration
        if len(np.unique(y[grow])) == 2 and len(np.unique(y[calibration])) == 2:
            self.trees = Boosted(x[grow], y[grow])
            self.calibrate = Isotonic(self.trees.margin(x[calibration]), y[calibration])
        return self

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offs) - 1, self.share)
        return np.clip(self.calibrate(self.trees.margin(features(data, offs, self.lexicon))), 0, 1)


def _lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons of all rows but those of each fold, and last that of all rows,
    from the numbers of toxic and clean rows that have an entry."""
    classes = 2 * FOLDS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(0, np.uint64), np.zeros((0, classes), np.int32)
        for batch in batches:
            for part, data, offs in words.slices(batch):
                w = Stripped(data, offs)
                fold, toxic = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                found = [(w.doc[at], entry) for at, entry in w.entries(w.data)]
                doc, entry = (np.concatenate(x) for x in zip(*found))
                key, of = np.unique(entry, return_inverse=True)
                pair = np.unique(of * np.int64(part.num_rows) + doc)
                cell = pair // part.num_rows * classes + (2 * fold + toxic)[pair % part.num_rows]
                counted = np.bincount(cell, minlength=len(key) * classes).reshape(-1, classes)
                both, of = np.unique(np.concatenate([seen, key]), return_inverse=True)
                total = np.zeros((len(both), classes), np.int32)
                total[of[: len(seen)]] = n
                total[of[len(seen) :]] += counted.astype(np.int32)
                seen, n = both, total
        columns = [pa.array(n[:, k].astype(np.int64)) for k in range(classes)]
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), *columns], names=["entry", *(f"n{k}" for k in range(classes))])

    schema = "entry bigint, " + ", ".join(f"n{k} bigint" for k in range(classes))
    counted = sample.select("text", "fold", "toxic").mapInArrow(rows, schema)
    sums = counted.groupBy("entry").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(classes)))
    size = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "toxic").count().collect()}
    toxic_rows = sum((F.col(f"n{2 * k + 1}") for k in range(FOLDS)), F.lit(0))
    held = sums.where(toxic_rows >= LEAST_ROWS).toArrow()  # the sample bounds them
    entry = held.column("entry").to_numpy().view(np.uint64)
    n = np.stack([held.column(f"n{k}").to_numpy() for k in range(classes)], 1).reshape(-1, FOLDS, 2)
    rows_of = np.array([[size.get((k, c), 0) for c in (0, 1)] for k in range(FOLDS)])
    out = []
    for without in [*range(FOLDS), None]:
        use = np.array([k for k in range(FOLDS) if k != without])
        (clean, toxic), (c, t) = n[:, use].sum(1).T, rows_of[use].sum(0) + 1.0
        odds = np.log((toxic + 0.5) / t) - np.log((clean + 0.5) / c)
        weight = odds - CONFIDENCE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        good = (toxic >= LEAST_ROWS) & (weight >= LEAST_WEIGHT)
        out.append(Lexicon(entry[good], weight[good]))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """A model from labelled rows whose crc32(key as text) mod 4 is not 2."""
    rest = F.crc32(F.col(key).cast("string")) % 4
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & (rest != 2)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest_hashes(usable, key, rows)  # bounded, so it may be broadcast
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    sample = checkpointed(sample.select(F.xxhash64(F.col(key)).alias("id"), "text", fold.alias("fold"), "toxic").repartition(8))
    lexicons = _lexicons(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in words.slices(batch):
                of = part.column(2).to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, len(FEATURES)), np.float32)
                for k in np.unique(of):
                    x[of == k] = features(*words.buffers(part.column(1).filter(pa.array(of == k))), lexicons[k])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "fold", "toxic", "x"])

    held = sample.select("id", "text", "fold", "toxic").mapInArrow(measure, "id bigint, fold int, toxic int, x array<float>").toArrow()
    ids = held.column("id").to_numpy()
    x = np.array(held.column("x").to_pylist(), np.float32).reshape(len(ids), len(FEATURES))
    order = np.lexsort((*x.T, ids))  # the fit does not depend on the rows' order
    return Model(lexicons[-1]).fit(x[order], held.column("toxic").to_numpy()[order].astype(float), held.column("fold").to_numpy()[order] == FOLDS - 1)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(data, offs), pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, score double")


def filter_rows(docs: DataFrame, model: Model, limit: float = LIMIT, text: str = "text") -> DataFrame:
    """The rows that score below the limit, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, batch.schema.field(at).name):
                yield part.filter(pa.array(shared.value.score(data, offs) < limit))

    return docs.mapInArrow(rows, docs.schema)
