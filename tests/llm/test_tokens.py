import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sparkhop.llm import bpe, memo, packing, words  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(docs, texts, tik):
    got = {r.doc_id: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in texts.items():
        ids = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_rows(docs, empty, texts, tik):
    twice = docs.union(docs)
    got = bpe.encode(twice, RANKS, P.PATTERN).collect()
    assert len(got) == 2 * len(texts) and all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() and list(r.ids) == tik.encode_ordinary(texts[r.doc_id] or "") for r in got)
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


CODER = bpe.ByteBpe(RANKS, P.PATTERN)
TOKENIZER, LIBRARY = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab.' \n\t\xa0\u2003\u3000\x85\x1cé,!s0", max_size=60)), max_size=5))
def test_bpe_of_many_texts_equals_the_library(some):
    ids, at = CODER.encode_all(*words.buffers(pa.array(some, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [TIK.encode_ordinary(t or "") for t in some]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t 'sé", max_size=80), st.text(alphabet="ab", min_size=200, max_size=900)))
def test_bpe_any_text(text):
    ids = CODER.encode(text)
    assert CODER.decode(ids) == text.encode()
    assert ids == [x for part in CODER.split(text) for x in slow(part.encode())]


def slow(piece):
    """Merges the lowest-ranked pair, leftmost first, until none is left."""
    if piece in CODER.ranks:
        return [CODER.ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(CODER.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in CODER.ranks]
        if not ranked:
            return [CODER.ranks[x] for x in parts]
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_word_tokenizer_equals_the_library(texts):
    mine, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    hard = ["Word, wORD. élan İstanbul, a. . ,, x's.", "ΑΣ ΟΔΥΣΣΕΥΣ", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "a b c　d", "é É, 12,5 a1.", "don't they'll", *[t or "" for t in texts.values()]]
    for _ in range(2):
        ids, at = mine.encode(*words.buffers(pa.array(hard)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in hard]


def test_word_tokenizer_forgets_and_learns_again(texts, monkeypatch):
    monkeypatch.setattr(memo, "MEMO", 50)
    test_word_tokenizer_equals_the_library(texts)


@given(st.lists(st.text(alphabet=st.sampled_from("aAb Zé'.s,<|>_9\n\u0130\u03a3!#"), max_size=30), max_size=4))
@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
def test_word_tokenizer_on_hard_texts(hard):
    ids, at = TOKENIZER.encode(*words.buffers(pa.array(hard, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in hard]


def check_pieces(rows, wanted):
    """Pieces cover each document once and fill sequences without gaps."""
    seqs, per = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for key, ids in wanted.items():
        at = 0
        for r in sorted(per[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(len(x) for x in wanted.values())
    padding = sum(2048 - n for n in (sum(x for _, x in p) for p in seqs.values()) if n & (n - 1))
    return padding / total


def test_packing(docs, empty, texts):
    library = Tokenizer.from_file(WORDS)
    wanted = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    rows = packing.pack(docs.coalesce(1), WORDS).collect()
    assert check_pieces(rows, wanted) < 0.05
    assert packing.pack(empty, WORDS).count() == 0
    twice = packing.pack(docs.union(docs), WORDS).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(x) for x in wanted.values())


def test_plan_is_optimal():
    import random

    for seed in range(30):
        r = random.Random(seed)
        cuts = [0]
        while len(cuts) < 12:
            cuts.append(cuts[-1] + r.randrange(1, 600))
        costs = [r.randrange(60) for _ in cuts]

        def price(chosen):
            out = 0
            for a, b in zip(chosen, chosen[1:]):
                n = b - a
                if n > 2048:
                    return 1 << 30
                out += (0 if n & (n - 1) == 0 and n >= packing.LEAST else 2048 - n) + costs[cuts.index(b)] + packing.SEQUENCE_COST
            return out

        best = min(price([0, *(c for k, c in enumerate(cuts[1:-1]) if m >> k & 1), cuts[-1]]) for m in range(1 << (len(cuts) - 2)))
        assert price(packing.plan(cuts, costs)) == best


def test_long_streams_are_cut_while_they_come():
    ends = np.zeros(10, bool)
    ends[3] = True
    packer, out = packing.Packer(ends, 2048, 0), []
    r = np.random.default_rng(0)
    docs = [r.integers(0, 9, n).astype("<u4") for n in (1, 300_000, 5, 140_000, 2047)]
    for k, d in enumerate(docs):
        out += packer.add(k, d)
        assert packer.size <= packing.BUFFER + 2048
    out += packer.flush(True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    from types import SimpleNamespace

    assert check_pieces([SimpleNamespace(**dict(zip(names, p))) for p in out], dict(enumerate(docs))) < 0.01
