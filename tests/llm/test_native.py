import datetime
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkhop.llm import imatch, licenses


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in imatch.query(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, follower = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + follower[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[20].fingerprint == got[21].fingerprint and got[21].near_next == 1.0
    assert got[40].fingerprint == got[41].fingerprint == got[42].fingerprint
    long = [i for i in texts if len(texts[i] or "") > 1200 and i not in (46, 48)]
    assert sum(got[i].near_edited for i in long) > sum(got[i].near_next for i in long if i not in (20, 21, 22, 23, 24))


def test_fingerprints_of_odd_tables(spark, empty):
    assert imatch.query(empty).count() == 0
    rows = [(5, "a b c"), (5, "a b c"), (None, "z"), (9, None), (-3, "q r s t u v")]
    got = imatch.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["-3", "5", "5", "9", "None"]
    assert imatch.query(spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")).first().near_next == 1.0


@pytest.mark.parametrize("block", [512, 4, 1])
def test_followers_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(imatch, "BLOCK_ROWS", block)
    keys = [3, 4, 10, 11, 12, 500, 501, 7000]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_next(rows, "doc_id", ["text"]).collect()}
    assert got == {k: f"t{keys[i - 1]}" for i, k in enumerate(keys)}


@pytest.mark.parametrize("kind", ["bigint", "string", "date"])
def test_followers_of_keys_of_any_type(spark, monkeypatch, kind):
    """Ends of bigint, an outlier, strings with any characters, equal keys."""
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 3)
    keys = {
        "bigint": [-(2**63), -(2**63) + 1, -5, *range(100, 130), 2**63 - 2, 2**63 - 1],
        "string": sorted(["", "a,b", 'q"q', "é\n", "z" * 50, "Z", "10", "9", "\\"], key=str.encode),
        "date": [datetime.date(2020, 1, 1) + datetime.timedelta(days=k * k) for k in range(20)],
    }[kind]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], f"doc_id {kind}, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_next(rows, "doc_id", ["text"]).collect()}
    assert got == {k: f"t{keys[i - 1]}" for i, k in enumerate(keys)}
    ends = imatch._bounds(rows, "doc_id", F.xxhash64("text"))
    assert len(ends) > len(keys) // 6  # an outlier does not put the others into one block


def test_fingerprints_of_any_key(spark):
    for kind, keys in (("bigint", [2**63 - 1, -(2**63), 7]), ("string", ["b", "a", "ä"])):
        d = spark.createDataFrame([(k, f"some words of {k}", "x") for k in [*keys, keys[0]]], f"doc_id {kind}, text string, parts string")
        got = imatch.query(d)
        assert got.columns[0] == "doc_id" and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, [*keys, keys[0]]))


@pytest.mark.parametrize("share, least", [(1e-4, 2), (0.02, 8)])
def test_lexicon_has_the_terms_of_the_band_only(spark, monkeypatch, share, least):
    # a large vocabulary of words of one document, more than there were buckets for
    monkeypatch.setattr(imatch, "LEAST_SHARE", share)
    rows = [(i, " ".join([f"only{i}x{k}" for k in range(1500)] + [f"pair{i // 2}", f"ten{i // 10}", "all"])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = imatch.lexicon(d)
    names = [f"pair{i}" for i in range(200)] * (least <= 2) + [f"ten{i}" for i in range(40)]
    want = {r[0] for r in spark.createDataFrame([(w,) for w in names], "w string").selectExpr("xxhash64(w)").collect()}
    assert len(held) == len(want) and set(held.tolist()) == want
    # texts that differ in words of their own only have the same fingerprint
    rows = spark.createDataFrame([(1, "pair3 ten7 typo1"), (2, "ten7 other pair3"), (3, "typo2")], "doc_id bigint, text string")
    got = {r.doc_id: list(r.parts) for r in imatch.fingerprint(rows, "text", held, "parts").collect()}
    assert got[1] == got[2] and got[1][0] is not None and set(got[3]) == {None}


def test_plans_do_not_show_the_lexicon(spark):
    """The driver keeps descriptions of each plan; they must not grow with the terms."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(400))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = imatch.lexicon(d)
    assert len(held) == 8000
    out = imatch.query(d)
    plan = out._jdf.queryExecution().toString()
    assert not any(str(h) in plan for h in held.tolist())
    # nor are they in the rows: the table is a subquery's value inside the lookup
    projects = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project [" in x]
    assert any("scalar-subquery" in x for x in projects) and not any("_places#" in x for x in projects)
    assert all(r.near_next == 1.0 for r in out.where("doc_id % 2 = 1").collect())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(h, seed):
    return xxhash.xxh64_intdigest((h & (2**64 - 1)).to_bytes(8, "little"), seed)


class Plain:
    """Fingerprints by their definition, term by term."""

    def __init__(self, texts):
        sets = [self.terms(t) for t in texts]
        n = len(sets)
        df = Counter(h for s in sets for h in s)
        least = max(min(imatch.LEAST_DOCS, n), math.ceil(imatch.LEAST_SHARE * n))
        self.lexicon = {h for h, k in df.items() if k >= least and math.log(n / k) >= math.log(1 / imatch.MOST_SHARE)}

    @staticmethod
    def terms(t):
        return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[\\x20\\x09-\\x0D]+", t.lower()) if w}

    def parts(self, t):
        held = sorted(self.terms(t) & self.lexicon)
        out = []
        for chosen in [held, *([h for h in held if self.place(scale, h) == j] for scale in imatch.SCALES for j in range(imatch.SUBSETS))]:
            seed = 42
            for h in chosen:
                seed = long_hash(h, seed)
            out.append(seed if chosen else None)
        return out

    @staticmethod
    def place(scale, h):
        return long_hash(h, xxhash.xxh64_intdigest(scale.to_bytes(4, "little"), 42)) & (scale - 1)


def test_fingerprints_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_SHARE", 0.6)
    r = random.Random(4)
    texts = [" ".join(r.choice("ÄB cd ef gh ij kl mn op qr st uv wx yz é".split()) + str(r.randrange(12)) for _ in range(r.choice([0, 5, 60, 200]))) for _ in range(60)]
    plain = Plain(texts)
    assert len(plain.lexicon) > 50
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    likeness = lambda a, b: (lambda both: sum(x == y and x is not None for x, y in zip(a, b)) / both if both else 1.0)(sum(x is not None or y is not None for x, y in zip(a, b)))
    shown = lambda parts: ":".join("-" if p is None else f"{p:016x}" for p in parts)
    for x in imatch.query(d).collect():
        t, after = texts[x.doc_id], texts[x.doc_id - 1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain.parts(t), plain.parts(edited), plain.parts(after)
        assert (x.fingerprint, x.edited_fingerprint) == (shown(a), shown(b)), x.doc_id
        assert math.isclose(x.near_edited, likeness(a, b)) and math.isclose(x.near_next, likeness(a, c))


def test_plans_stay_in_the_jvm(docs):
    plan = imatch.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.fixture(scope="module")
def model(docs):
    return licenses.Model(licenses.sample_lines(docs))


LINES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "proprietary": "Copyright 2021 the authors. All rights reserved.",
    "unknown": "Distributed under the terms of the Frobozz licence agreement",
}


def test_license_lines(spark, model):
    rows = [(i, f"The river and the stone.\n{line}\nThe garden was quiet.") for i, line in enumerate(LINES.values())]
    rows += [(90, "\n".join(LINES.values())), (91, "He lost his driving license.\nThe public was free to use the garden."), (92, None), (93, ""), (94, "\n\n")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(d, model).collect()}
    for i, family in enumerate(LINES):
        assert (got[i].families, got[i].n_license_lines) == (family, 1)
    assert got[90].families == ",".join(sorted(LINES)) and got[90].n_license_lines == len(LINES)
    assert all(got[i].n_license_lines == 0 and got[i].families == "" for i in (91, 92, 93, 94))
    where = licenses.lines(d, model).where("doc_id = 0").first()
    assert (where.line, where.paragraph) == (1, LINES["mit"]) and where.probability > 0.5


def test_features_in_columns_and_in_python_agree(spark):
    from pyspark.sql import functions as F

    hard = ["Released under the MIT License.", "a", "A-b c9 é a-b", "one two two one"]
    d = spark.createDataFrame([(t,) for t in hard], "t string")
    ws = F.filter(F.split(F.lower("t"), licenses._SPLIT), lambda w: w != "")
    got = {r[0]: sorted(r[1]) for r in d.select("t", licenses._features(ws)).collect()}
    assert got == {t: licenses.buckets(t) for t in hard}


def test_license_query_on_any_table(docs, empty, texts, model):
    got = licenses.scan(docs, model).collect()
    assert {r.doc_id for r in got} == set(texts) and sum(r.n_license_lines for r in got) == 0
    assert licenses.scan(empty, model).count() == 0


WRAPPED = {
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the "Software")',
}


def test_wrapped_notices_are_named(spark, model):
    rows = [(i, f"The river and the stone.\n\n{t}\n\nThe garden was quiet.") for i, t in enumerate(WRAPPED.values())]
    rows += [(0, rows[0][1])]  # equal rows add up
    got = {r.doc_id: (r.families, r.n_license_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got == {0: ("gpl", 6), 1: ("bsd", 2), 2: ("mit", 2)}


def plain_lines(text, model):
    """The judged lines of a text by their definition, run by run."""
    rows, found = text.split("\n"), {}
    cue = bool(set(licenses._words(text)) & set(licenses.cues()))
    whole = lambda v: np.round(np.clip(v, -2000, 2000) * licenses.SCALE)
    pairs = lambda run: (lambda w: set(map(" ".join, zip(w, w[1:]))) or set(w))(licenses._words("\n".join(run)))
    for i in range(len(rows)):
        for n in range(1, min(licenses.RUN_LINES if cue else 1, len(rows) - i) + 1):
            run = rows[i : i + n]
            if n > 1 and not all(re.search("(?i)[a-z0-9]", x) for x in run) or not licenses._words("\n".join(run)):
                continue
            at = licenses.buckets("\n".join(run))
            root = math.sqrt(len(at))
            gate = whole(model.gate)[at].sum() / licenses.SCALE / root + model.gate_bias
            if 1 / (1 + math.exp(-gate)) < licenses.GATE:
                continue
            z = np.array([whole(model.family[:, k])[at].sum() / licenses.SCALE / root + float(model.family_bias[k]) for k in range(len(licenses.CLASSES))])
            probability, guess = 1 / np.exp(z - z.max()).sum(), licenses.CLASSES[int(z.argmax())]
            named = False
            for t in licenses.TEMPLATES.get(guess, []):
                want = set(licenses._wanted(t))
                k = len(want & pairs(run))
                named |= k >= licenses.CONFIRM * len(want) and (n == 1 or len(want & pairs(run[:-1])) < k and len(want & pairs(run[1:])) < k)
            family = guess if named and probability >= licenses.SURE else licenses.UNKNOWN
            if n == 1 or family != licenses.UNKNOWN:
                rank = licenses.RUN_LINES + 1 if family == licenses.UNKNOWN else n
                for line in range(i, i + n):
                    found.setdefault(line, []).append((rank, i, "\n".join(run), family, probability))
    return {line: min(x) for line, x in found.items()}


def test_license_lines_match_a_plain_version(spark, model):
    r, pool = random.Random(6), [*LINES.values(), *WRAPPED.values(), "", " - ", "The river.", "version 3 of the license, or", "see the file", "é ü", "with or without", "MIT"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for x in licenses.lines(d, model).collect():
        got.setdefault(x.doc_id, {})[x.line] = x
    for i, t in enumerate(texts):
        want = plain_lines(t, model)
        assert {k: (x.paragraph, x.family) for k, x in got.get(i, {}).items()} == {k: (x[2], x[3]) for k, x in want.items()}, i
        assert all(math.isclose(got[i][k].probability, x[4], rel_tol=1e-9) for k, x in want.items())


def test_every_template_needs_a_cue():
    cues = set(licenses.cues())
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        want = licenses._wanted(t)
        assert sum(not cues & set(p.split()) for p in want) < licenses.CONFIRM * len(want)
