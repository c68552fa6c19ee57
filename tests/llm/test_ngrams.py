import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkhop.llm import ngrams, quality
from tests.llm.conftest import prose


def discounts(counts):
    n = [max(1, sum(c == i for c in counts)) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return [min(max(d, 0.1), i - 0.1) for d, i in zip(raw, (1, 2, 3))]


class Plain:
    """The model of one language, n-gram by n-gram, from its definition."""

    def __init__(self, texts, least):
        cut = lambda t: [t[i : i + 5] for i in range(len(t) - 4)]
        every = Counter(g for t in texts for g in cut(t))
        docs = Counter(g for t in texts for g in set(cut(t)))
        self.levels, counts, basis = {}, {g: n for g, n in every.items() if docs[g] >= least}, every
        for order in range(5, 1, -1):
            cells, follow = defaultdict(list), defaultdict(list)
            for g, n in basis.items():
                cells[g[-2]].append(n)
            d = {c: discounts(ns) for c, ns in cells.items()}
            for g, n in counts.items():
                follow[g[:-1]].append((n, d[g[-2]][min(n, 3) - 1]))
            self.levels[order] = counts, d, follow
            counts = basis = Counter(g[1:] for g in counts)

    def p(self, g):
        if len(g) == 1:
            return 1 / 256
        counts, d, follow = self.levels[len(g)]
        seen = follow.get(g[:-1])
        if not seen:
            return self.p(g[1:])
        total = sum(n for n, _ in seen)
        n = counts.get(g, 0)
        return ((n - d[g[-2]][min(n, 3) - 1]) if n else 0) / total + sum(x for _, x in seen) / total * self.p(g[1:])


@pytest.mark.parametrize("limits", [ngrams.Limits(), ngrams.Limits(2, 2000, 3, 2, 300), ngrams.Limits(3, 600, 64, 3, 50)])
def test_scores_match_a_plain_model(spark, limits):
    """Whatever the blocks, shards, merges and pieces of long texts."""
    texts = [(i, prose(i % 22, 30 + i), "en" if i % 3 else "de") for i in range(30)]
    texts += [(100, prose(3, 900), "en"), (101, "", "en"), (102, None, "de"), (103, "abcd", None), (104, "abcde", None), (105, "abcde", None), (106, "é😀 ß ÄÖ", "de"), (107, "only here: \x00\x7f~", "xx"), (None, prose(5, 60), "de")]
    d = spark.createDataFrame([(*r, "a", 7) for r in texts], "doc_id bigint, text string, lang string, block string, n_grams int").repartition(5)
    got = {r.doc_id: r for r in quality.score(d, limits=limits).collect()}
    assert len(got) == len(texts)
    models = {lang: Plain([(t or "").encode() for _, t, x in texts if x == lang], limits.least_docs) for lang in ("en", "de", "xx", None)}
    for i, t, lang in texts:
        raw = (t or "").encode()
        n = max(0, len(raw) - 4)
        assert got[i].n_grams == n and got[i].lang == lang
        if n:
            want = -sum(math.log(models[lang].p(raw[k : k + 5])) for k in range(n)) / n
            assert math.isclose(got[i].log_perplexity, want, abs_tol=6e-4), i
        else:
            assert got[i].log_perplexity is None
    assert quality.score(d.limit(0)).count() == 0


def test_probabilities_sum_to_one_after_any_history():
    texts = [prose(i, 80) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 20)], names=["text", "lang"])
    gram, count, docs = ngrams.counted([batch], ngrams.Limits())
    model = ngrams.Model(gram, count, docs, 16)
    for history in (gram[0] >> np.uint64(8), gram[-1] >> np.uint64(8), np.uint64(7)):  # the last is unseen
        every = (history << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose(model.p(every).sum(), 1.0, rel_tol=1e-9)


def test_senseless_order_is_rejected(spark):
    r = random.Random(5)
    nouns = [f"{a}{b}" for a in ("sto", "riv", "gar", "lan", "mar", "bri") for b in ("ne", "er", "den", "tern", "ket")]
    follow = {w: r.sample(nouns, 5) for w in nouns}

    def sense(n):
        w = [r.choice(nouns)]
        while len(w) < n:
            w.append(r.choice(follow[w[-1]]))
        return w

    rows = [(i, " ".join(sense(200)), "en") for i in range(200)]
    mixed = [sense(200) for _ in range(6)]
    for w in mixed:
        r.shuffle(w)
    rows += [(1000 + i, " ".join(w), "en") for i, w in enumerate(mixed)]
    got = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert sum(got[i].kept for i in range(200)) >= 198 and not any(got[i].kept for i in got if i >= 1000)


@pytest.mark.parametrize("few", [40, 99, 100])
def test_a_small_language_has_its_own_band_at_any_size(spark, few):
    rows = [(i, prose(i, 200), "en") for i in range(300)]
    rows += [(1000 + i, "".join(chr(0x430 + ord(c) - 97) if "a" <= c <= "z" else c for c in prose(7000 + i, 200)), "xx") for i in range(few)]
    got = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert sum(got[i] for i in range(300)) >= 298 and sum(v for i, v in got.items() if i >= 1000) >= few - 1
