"""Secret scans: base patterns, and a linear-chain conditional random field.

A text's tokens are runs of value characters and runs of other marks.  The field
tags each as outside, begin or inside of a secret from its shape, its
neighbours, and rates of its whole text; Viterbi decoding runs over whole texts
in blocks (max-plus products of 3 x 3 matrices, so the loop length does not
follow the text).  It is trained on the whole texts of at most ``SAMPLE_ROWS``
documents, tagged by the base patterns, into which made-up secrets of further
forms are planted with a fixed seed.  Base spans always stay; spans of the field
that overlap none of them are added with kind ``crf``.  The time for a text is
linear in its length, however many spans it has.

Defined results: null and empty texts have no spans; repeated rows give
repeated rows, and rows with a null key are scanned like others; an empty table
gives no rows.  ``scan`` reads key and text alone and ``redact`` keeps all columns
by place, so names cannot clash.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import smallest_hashes

SAMPLE_ROWS = 400
#: Windows of a training text at most, and tokens of a window.
WINDOWS, WIDTH = 64, 64
LEAST_LENGTH = 8
STRIPPED = b".,;:=\"'`-"
KINDS = ("assign", "access", "hex", "crf")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
HINTS = ("passw", "secret", "token", "api")

Span = tuple[int, int, int]  # start, index in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 value character, 2 other mark
_KIND[33:] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in "+/_.-"]] = 1
_KIND[128:] = 1


def _set(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return out


_DIGIT, _UPPER, _LOWER, _HEXES, _HIGH, _JOIN = _set(string.digits), _set(string.ascii_uppercase), _set(string.ascii_lowercase), _set("0123456789abcdef"), _set(range(128, 256)), _set("+/_-")
_SIGN, _QUOTE = _set("=:"), _set("\"'`")
KEYWORDS = "password passwd pwd pass passphrase secret secrets token tokens api apikey api_key api-key key keys access_key access-key secret_key client_secret auth authorization bearer credential credentials private login".split()
PREFIXES = ("AKIA", "ghp_", "gho_", "eyJh", "xoxb", "xoxp", "AIza", "sk_l", "sk-p", "glpa")


def _hashes(listed) -> np.ndarray:
    data, offs = words.buffers(pa.array(listed))
    return np.sort(words.span_hashes(data, offs[:-1], offs[1:]))


_KEYS, _HEADS = _hashes(KEYWORDS), _hashes(PREFIXES)


def _member(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    return s[np.minimum(np.searchsorted(s, h), len(s) - 1)] == h


class Tokens:
    """Tokens of some texts: byte spans, row of each, whether each is its row's
    first, and whether it touches the one before."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        kind = _KIND[data]
        new = np.ones(len(data) + 1, bool)
        if len(data):
            new[1:-1] = kind[1:] != kind[:-1]
            new[offs] = True
        edge = np.flatnonzero(new)
        start, end = edge[:-1], edge[1:]
        real = kind[start] > 0 if len(data) else np.zeros(0, bool)
        self.data, self.start, self.end = data, start[real], end[real]
        self.mark = kind[self.start] == 2
        self.row = np.searchsorted(offs, self.start, side="right") - 1
        n = len(self.start)
        self.first = np.ones(n, bool)
        self.touches = np.zeros(n, bool)
        if n:
            self.first[1:] = self.row[1:] != self.row[:-1]
            self.touches[1:] = (self.start[1:] == self.end[:-1]) & ~self.first[1:]

    def features(self) -> np.ndarray:
        """A 0/1 row of each token, float32."""
        data, n = self.data, len(self.start)
        length = self.end - self.start

        def amount(mask: np.ndarray) -> np.ndarray:
            run = np.zeros(len(data) + 1, np.int32)
            np.cumsum(mask, out=run[1:])
            return run[self.end] - run[self.start]

        digit, upper, lower = amount(_DIGIT[data]), amount(_UPPER[data]), amount(_LOWER[data])
        hexes, high, join = amount(_HEXES[data]), amount(_HIGH[data]), amount(_JOIN[data])
        kind = _DIGIT[data].astype(np.int8) + 2 * _UPPER[data] + 4 * _LOWER[data]
        turn = np.zeros(len(data), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turns = amount(turn) - (turn[self.start] if n else 0)
        value = ~self.mark
        low = words.span_hashes(words._LOWER[data], self.start, self.end)
        head = words.span_hashes(data, self.start, np.minimum(self.end, self.start + 4))
        word = value & (digit == 0) & (join == 0) & ((upper == 0) | (upper == 1) & ~_LOWER[data[self.start]] if n else True)
        key = value & _member(low, _KEYS)
        sign = self.mark & (amount(_SIGN[data]) > 0)
        quote = self.mark & (amount(_QUOTE[data]) > 0)

        def back(mask: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, bool)
            out[k:] = mask[: max(0, n - k)]
            for j in range(k):  # not across texts
                out[j:] &= ~self.first[: max(0, n - j)] if j else ~self.first
            return out

        def ahead(mask: np.ndarray) -> np.ndarray:
            out = np.zeros(n, bool)
            out[:-1] = mask[1:] & ~self.first[1:]
            return out

        key_before = back(key, 1) | back(key, 2) | back(key, 3)
        rich = value & (length >= 8) & (digit > 0) & (upper + lower > 0)
        rows = int(self.row[-1]) + 1 if n else 0
        size = np.maximum(np.bincount(self.row, minlength=rows), 1)
        digits_of_text = (np.bincount(self.row, weights=digit > 0, minlength=rows) / size)[self.row] if n else np.zeros(0)
        marks_of_text = (np.bincount(self.row, weights=self.mark, minlength=rows) / size)[self.row] if n else np.zeros(0)
        columns = [
            np.ones(n, bool), self.mark, word, high > 0,
            value & (length < 4), value & (length >= 4) & (length < 8), value & (length >= 8) & (length < 16), value & (length >= 16) & (length < 32), value & (length >= 32),
            value & (digit > 0), value & (upper > 1), value & (digit > 0) & (upper > 0) & (lower > 0), value & (digit == length), (hexes == length) & (digit > 0) & (length >= 16),
            value & (turns >= 3), value & (turns >= 6), rich, value & (join > 0), rich & (turns >= 4) & (length >= 16), value & _member(head, _HEADS) & (length >= 16),
            key, sign, quote, self.touches, back(sign, 1), back(quote, 1), ahead(quote),
            key_before, key_before & (back(sign, 1) | back(sign, 2)), key_before & rich, key_before & rich & (back(sign, 1) | back(sign, 2)),
            self.touches & back(rich, 1), rich & back(sign, 1), back(self.mark, 1), back(word, 1), rich & (digits_of_text > 0.2), rich & (marks_of_text > 0.3),
        ]
        return np.stack(columns, 1).astype(np.float32)


class Field:
    """Weights of the tagger; tags are 0 outside, 1 begin, 2 inside."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.emit, self.step, self.begin = emit, step, begin

    BLOCK = 64

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tag of each token; ``first`` marks where texts begin."""
        n = len(x)
        if not n:
            return np.zeros(0, np.int64)
        k = self.BLOCK
        blocks = -(-n // k)
        e = np.zeros((blocks * k, 3))
        e[:n] = x @ self.emit
        reset = np.ones(blocks * k, bool)  # padding starts afresh, so it favours no tag
        reset[:n] = first
        e, reset = e.reshape(blocks, k, 3), reset.reshape(blocks, k)
        back = np.empty((k, blocks, 3, 3), np.int8)  # best tag before, by entry tag and tag
        v = None
        for j in range(k):
            step = np.where(reset[:, j, None, None], self.begin[None, None, :], self.step[None])  # block, before, tag
            if v is None:
                v = step + e[:, j, None, :]
                continue
            every = v[:, :, :, None] + step[:, None, :, :]  # block, entry, before, tag
            back[j] = every.argmax(2)
            v = every.max(2) + e[:, j, None, None, :][:, 0]
        scores, came = np.zeros(3), np.empty((blocks, 3), np.int64)
        for b in range(blocks):
            every = scores[:, None] + v[b]
            came[b] = every.argmax(0)
            scores = every.max(0)
            scores -= scores.max()
        leave, enter = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
        tag = int(scores.argmax())
        for b in range(blocks - 1, -1, -1):
            leave[b] = tag
            enter[b] = tag = int(came[b, tag])
        out = np.empty((blocks, k), np.int64)
        out[:, -1] = leave
        at = np.arange(blocks)
        for j in range(k - 1, 0, -1):
            out[:, j - 1] = back[j, at, enter, out[:, j]]
        return out.ravel()[:n]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
        """Gradient ascent (Adam) on the log likelihood of padded sequences:
        x (sequences, tokens, features), y tags, mask real tokens."""
        m, t, f = x.shape
        params = [np.zeros((f, 3)), np.zeros((3, 3)), np.zeros(3)]
        params[1][0, 2] = -2.0
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        flat, hot = x.reshape(-1, f), np.eye(3)[y]
        hot *= mask[..., None]
        real = mask.sum()
        pair_seen = np.einsum("mti,mtj->ij", hot[:, :-1], hot[:, 1:])
        seen = [flat.T @ hot.reshape(-1, 3), pair_seen, hot[:, 0].sum(0)]

        def norm(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

        for i in range(1, rounds + 1):
            e = (flat @ params[0]).reshape(m, t, 3)
            alpha, beta = np.empty((t, m, 3)), np.zeros((t, m, 3))
            alpha[0] = e[:, 0] + params[2]
            for j in range(1, t):
                new = norm(alpha[j - 1][:, :, None] + params[1], 1) + e[:, j]
                alpha[j] = np.where(mask[:, j, None], new, alpha[j - 1])
            for j in range(t - 2, -1, -1):
                new = norm(params[1][None] + (e[:, j + 1] + beta[j + 1])[:, None, :], 2)
                beta[j] = np.where(mask[:, j + 1, None], new, beta[j + 1])
            z = norm(alpha[-1], 1)
            p = np.exp(alpha + beta - z[None, :, None]) * mask.T[..., None]
            pair = np.zeros((3, 3))
            for j in range(1, t):
                both = alpha[j - 1][:, :, None] + params[1] + (e[:, j] + beta[j])[:, None, :] - z[:, None, None]
                pair += (np.exp(np.minimum(both, 0)) * mask[:, j, None, None]).sum(0)
            expected = [flat.T @ p.transpose(1, 0, 2).reshape(-1, 3), pair, p[0].sum(0)]
            for p_, (a, b), s, x_ in zip(params, moments, seen, expected):
                g = (s - x_) / real * 100 - decay * p_ * 100
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p_ += rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
        return Field(*params)


def _made_up(r: random.Random) -> tuple[str, str]:
    """(text before, secret) of a made-up secret."""
    chars = string.ascii_letters + string.digits
    pick = lambda n, of=chars: "".join(r.choice(of) for _ in range(n))
    forms = [
        lambda: ("Authorization: Bearer ", pick(r.randint(20, 60))),
        lambda: (r.choice(["pwd=", "pwd: ", "passphrase: ", "passphrase = "]), pick(r.randint(8, 20), chars + "!@#%^&*") + pick(4)),
        lambda: ("", "ghp_" + pick(36)),
        lambda: ("", "eyJh" + pick(30) + "." + pick(40) + "." + pick(30)),
        lambda: (r.choice(["aws_secret_access_key = ", "secret_key: ", "client_secret="]), pick(40, chars + "+/")),
        lambda: (r.choice(["key = ", "private key: ", "credentials: ", "auth = "]), '"' + pick(r.randint(20, 44)) + '"'),
        lambda: ("", "xoxb-" + pick(11, string.digits) + "-" + pick(24)),
        lambda: ("", "AIza" + pick(35, chars + "_-")),
        lambda: (r.choice(["password is ", "token: ", "secret="]), pick(r.randint(8, 24))),
        lambda: ("", pick(40, "0123456789abcdef")),
        lambda: ("", "AKIA" + pick(16, string.ascii_uppercase + string.digits)),
    ]
    return r.choice(forms)()


def _decoy(r: random.Random) -> str:
    """Text that is no secret, though it looks a little like one."""
    pick = lambda n, of: "".join(r.choice(of) for _ in range(n))
    return r.choice(
        [
            lambda: f"https://www.{pick(8, string.ascii_lowercase)}.com/{pick(6, string.ascii_lowercase)}/{pick(4, string.digits)}",
            lambda: f"{pick(7, string.ascii_lowercase)}.{pick(2, string.digits)}@mail{pick(1, string.digits)}.example.com",
            lambda: f"+{pick(2, string.digits)}-{pick(3, string.digits)}-{pick(4, string.digits)}",
            lambda: pick(16, string.digits),
            lambda: f"{pick(4, string.digits)}-{pick(2, string.digits)}-{pick(2, string.digits)}",
            lambda: f"the token {pick(7, string.ascii_lowercase)} key {pick(5, string.ascii_lowercase)}",
            lambda: f"{pick(3, string.digits)}.{pick(3, string.digits)}.{pick(2, string.digits)}.{pick(3, string.digits)}",
            lambda: f"{pick(9, string.ascii_uppercase)}!!",
            lambda: f"version {pick(1, string.digits)}.{pick(2, string.digits)}",
        ]
    )()


def _planted(text: str, r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """(text with made-up secrets and decoys between its lines, spans)."""
    parts, spans, at = [], [], 0
    for line in re.split(r"(?<=[.\n|])", text):
        if r.random() < 0.08:
            before, secret = _made_up(r)
            line = f" {before}"
            spans.append((at + len(line), at + len(line) + len(secret)))
            line += secret + " "
        elif r.random() < 0.08:
            line = f" {_decoy(r)} "
        parts.append(line)
        at += len(line)
    whole = "".join(parts)
    spans += [m.span(2) for m in ASSIGN.finditer(whole) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", whole)]
    return whole, spans


def examples(text: str, r: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of windows of a text with planted secrets: those with a
    secret and a quarter of the others, of each kind half of ``WINDOWS`` at most,
    drawn from all over the text.  Features are those of the whole text."""
    whole, spans = _planted(text, r)
    data, offs = words.buffers(pa.array([whole]))
    cp = words.code_points(data)
    tok = Tokens(data, offs)
    tags = np.zeros(len(tok.start), np.int8)
    a, b = cp[tok.start], cp[tok.end]
    for s, e in spans:
        i, j = np.searchsorted(b, s, side="right"), np.searchsorted(a, e)
        hit = i + np.flatnonzero((b[i:j] - a[i:j] > 2) | ~tok.mark[i:j])
        tags[hit[tags[hit] == 0]] = 2
        if len(hit):
            tags[hit[0]] = 1
    x = tok.features()
    kinds: tuple[list[int], list[int]] = ([], [])  # without and with a secret
    for i in range(0, len(x), WIDTH):
        some = bool(tags[i : i + WIDTH].any())
        if some or r.random() < 0.25:
            kinds[some].append(i)
    starts = [i for held in kinds for i in (held if len(held) <= WINDOWS // 2 else r.sample(held, WINDOWS // 2))]
    return [(x[i : i + WIDTH], tags[i : i + WIDTH]) for i in sorted(starts)]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", seed: int = 11) -> Field:
    """A field from the whole texts of ``rows`` documents at most (smallest
    hashes of the key), of each at most ``WINDOWS`` windows of ``WIDTH`` tokens."""
    chosen = smallest_hashes(docs.select(key).where(F.col(key).isNotNull()), key, rows).distinct()
    usable = docs.join(F.broadcast(chosen), key, "left_semi").where(F.length(F.col(text)) > 0)
    width = len(Tokens(*words.buffers(pa.array(["x"]))).features()[0])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = examples(t, random.Random(f"{seed}:{h}:{len(t)}"))
                x, y = [np.ascontiguousarray(x, np.float32).tobytes() for x, _ in found], [y.tobytes() for _, y in found]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(x), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["h", "x", "y"])

    shaped = usable.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("t")).repartition(8)
    held = sorted((r[0], bytes(r[2]), bytes(r[1])) for r in shaped.mapInArrow(made, "h bigint, x binary, y binary").collect())  # the fit does not depend on the rows' order
    found = [(np.frombuffer(x, np.float32).reshape(-1, width), np.frombuffer(y, np.int8)) for _, y, x in held]
    r = random.Random(seed)
    for _ in range(max(0, 100 - len({h for h, *_ in held}))):
        found += examples("Nothing to see here.", r)
    m = len(found)
    x, y, mask = np.zeros((m, WIDTH, width)), np.zeros((m, WIDTH), np.int64), np.zeros((m, WIDTH), bool)
    for i, (a, b) in enumerate(found):
        x[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, True
    return Field.fit(x, y, mask)


def find(data: np.ndarray, offs: np.ndarray, texts: list[str | None], field: Field) -> list[list[Span]]:
    """All spans of each text, by start and kind."""
    out = [base_spans(t) if t else [] for t in texts]
    tok = Tokens(data, offs)
    tags = field.decode(tok.features(), tok.first)
    begins = (tags == 1) | (tags == 2) & (np.append(0, tags[:-1]) == 0) | (tags == 2) & tok.first
    at = np.flatnonzero(begins)
    if not len(at):
        return out
    goes_on = (tags == 2) & ~begins
    stop = np.flatnonzero(~goes_on)
    following = np.searchsorted(stop, at, side="right")
    last = np.where(following < len(stop), stop[np.minimum(following, len(stop) - 1)], len(tags)) - 1
    cp = words.code_points(data)
    taken = [_union(spans) for spans in out]
    for row, start, end in zip(tok.row[at].tolist(), tok.start[at].tolist(), tok.end[last].tolist()):
        raw = data[start:end].tobytes()
        start += len(raw) - len(raw.lstrip(STRIPPED))
        end -= len(raw) - len(raw.rstrip(STRIPPED))
        if end - start < LEAST_LENGTH:
            continue
        a, b = int(cp[start] - cp[offs[row]]), int(cp[end] - cp[offs[row]])
        starts, ends = taken[row]
        before = bisect_left(starts, b)  # of these the last ends last
        if not before or ends[before - 1] <= a:
            out[row].append((a, 3, b))
    return [sorted(spans) for spans in out]


def _union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint runs that sorted spans cover."""
    starts, ends = [], []
    for s, _, e in spans:
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, "t"):
                found = find(data, offs, part.column(1).to_pylist(), shared.value)
                base = [[s for s in spans if s[1] < 3] for spans in found]
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
                digest = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest, pa.string()), pa.array(list(map(joined, found)), pa.string())], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(rows, f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns, each secret's span replaced by ``mark``; a bigint
    column ``size``, if there, gets the new number of code points."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)
    size_at = docs.columns.index(size) if size in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, batch.schema.field(at).name):
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(find(data, offs, texts, shared.value)):
                    if spans:
                        t, done, pieces = texts[i], 0, []
                        for s, _, e in spans:
                            if e > done:
                                pieces += [t[done : max(s, done)], mark] if s >= done else []
                                done = e
                        texts[i] = "".join(pieces) + t[done:]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if size_at is not None:
                    columns[size_at] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(rows, docs.schema)
