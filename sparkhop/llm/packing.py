"""Order-preserving packing of documents into training sequences.

Documents are range-partitioned and sorted by key, tokenised whole, and each
partition is cut as one stream of ids.  Cuts may fall at document ends, at
sentence ends, and inside longer stretches every ``STRETCH`` ids.  A dynamic
programme over the possible cuts minimises padding plus penalties for cutting
inside documents; the best predecessor within one sequence length comes from a
monotone queue.  A sequence whose length is a power of two is not padded, so
those lengths are tried as well, and a stream's rest is cut into them.

The programme runs over ``BUFFER`` ids (64 sequences) at a time, which bounds
memory: its last sequence is planned again with what follows, the others stand.
The plan is the optimum of each such window, not of the whole stream.  Streams
start at the bounds that Spark samples for the range partitions, so another
number of partitions gives other sequences; ids and their order stay.

Defined results: a null or empty text is the end id alone; repeated rows and
keys are packed once for each row; rows with a null key come first, and rows of
equal keys are ordered by a hash of the text, which also spreads them over
partitions.  Other columns are not read, so their names cannot clash.  Nothing
is dropped: each id lies in exactly one piece.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .memo import Memo

LENGTH = 2048
#: Costs in padded ids: a sequence, a cut at a sentence end, a cut elsewhere.
SEQUENCE_COST, SENTENCE_COST, OTHER_COST = 1, 2, 48
#: Ids between two possible cuts at most.
STRETCH = 256
#: Ids that are planned at once.
BUFFER = 1 << 17
#: Least length, a power of two, that is tried unpadded inside a stream.
LEAST = 256
#: The byte alphabet of byte-level vocabularies: printable Latin-1 characters
#: stand for themselves, the other bytes for those from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


class WordTokenizer:
    """Ids of texts by the tokenizers library.  Its pre-tokens end at white
    space, and after an ASCII letter that a mark follows, and its normaliser does
    not look across such places; so a text's ids are those of the parts between
    them.  Each distinct part of some texts is looked up once by its hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 2, bool)
        for piece, i in vocabulary.items():
            body = piece.removesuffix("</w>")
            if body != piece and body and set(body) <= set(".!?"):
                self.ends_sentence[i] = True
        #: Bytes that begin added tokens, which are found in the text as it is:
        #: a word with one is not parted, and keeps its case.
        self.opens_added = np.zeros(256, bool)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.opens_added[token.content.encode()[0]] = True
        self.added = frozenset(np.flatnonzero(self.opens_added).tolist())
        self.memo = Memo()

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and their number)."""
        w = words.Words(data, offs)
        low, start, end = words._LOWER[data], w.start, w.end  # case does not count
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        odd = np.zeros(len(start), bool)
        if len(at := np.flatnonzero(self.opens_added[data])):
            odd[np.searchsorted(start, at, side="right") - 1] = True
            for a, b in zip(start[odd].tolist(), end[odd].tolist()):
                low[a:b] = data[a:b]
        marks = np.maximum.accumulate(np.where(_MARK[low], -1, np.arange(len(low))))[end - 1] + 1  # where a word's last marks begin
        two = ~odd & (marks > start) & (marks < end) & _LETTER[low[marks - 1]]
        place = np.concatenate([[0], np.cumsum(1 + two)])  # of each word's first part
        start, end = np.repeat(start, 1 + two), np.repeat(end, 1 + two)
        end[place[:-1][two]] = start[place[:-1][two] + 1] = marks[two]
        ids, at = self.memo.ids(low, start, end, self.ids_of)
        return ids, at[place[w.first]]

    def ids_of(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of word parts.  A run of Latin letters, or of ASCII marks, is one
        pre-token and goes to the model by itself, in the byte alphabet."""
        out, rest = [], []
        for part in parts:
            run = part.decode("utf-8", "replace")
            if not self.added.isdisjoint(part):
                plain = False
            elif run.isascii():
                plain = run.isalpha() or not any(map(str.isalnum, run)) and run.isprintable()
            elif plain := run.isalpha() and max(run) < "\u0250" and "\u0130" not in run:
                run = run.lower().encode().decode("latin-1").translate(_BYTE_ALPHABET)
            out.append([t.id for t in self.model.tokenize(run)] if plain else [])
            if not plain:
                rest.append((len(out) - 1, run))
        if rest:
            for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([run for _, run in rest], add_special_tokens=False)):
                out[k] = e.ids
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def plan(cuts: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Chosen cuts, first and last included, of a stream whose possible cuts
    are ``cuts`` (ascending, gaps of at most ``length``).  Minimises the sum of
    each sequence's padding and cost and of the cuts' costs."""
    at = np.array(cuts)
    before = []  # for each length that needs no padding, the cut so far back, or -1
    for k in range(LEAST.bit_length() - 1, length.bit_length()):
        if 1 << k < length:
            j = np.searchsorted(at, at - (1 << k))
            before.append(np.where(at[j] == at - (1 << k), j, -1))
    # most cuts have none: those that have are listed, the others share an empty tuple
    unpadded: list[tuple[int, ...]] = [()] * len(cuts)
    if before:
        table = np.stack(before, 1)
        for i in np.flatnonzero((table >= 0).any(1)).tolist():
            unpadded[i] = tuple(j for j in table[i].tolist() if j >= 0)
    best, back = [0] * len(cuts), [0] * len(cuts)
    # (best + cut, cut, index): the first ascending, so the head is least
    sums, places, indices, head = [cuts[0]], [cuts[0]], [0], 0
    fixed = length + SEQUENCE_COST
    for i in range(1, len(cuts)):
        c = cuts[i]
        least = c - length
        while places[head] < least:
            head += 1
        value, from_ = sums[head] + fixed - c, indices[head]
        for j in unpadded[i]:
            if best[j] + SEQUENCE_COST < value:
                value, from_ = best[j] + SEQUENCE_COST, j
        value += costs[i]
        best[i], back[i] = value, from_
        value += c
        while len(sums) > head and sums[-1] >= value:
            sums.pop(), places.pop(), indices.pop()
        sums.append(value), places.append(c), indices.append(i)
    out, i = [cuts[-1]], len(cuts) - 1
    while i:
        i = back[i]
        out.append(cuts[i])
    return out[::-1]


class Packer:
    """Packs one stream of documents; gives pieces as they are decided."""

    def __init__(self, ends_sentence: np.ndarray, length: int, first_sequence: int):
        self.ends, self.length, self.sequence = ends_sentence, length, first_sequence
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # (key, start, document's ids, ids)
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), BUFFER):
            self.parts.append((key, at, len(ids), ids[at : at + BUFFER]))
            self.size += len(self.parts[-1][3])
            if self.size >= BUFFER:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        edges = np.cumsum([0] + [len(p[3]) for p in self.parts])
        cost = np.full(self.size + 1, -1, np.int32)
        cost[1:][self.ends[ids]] = SENTENCE_COST
        whole = [p[1] + len(p[3]) == p[2] for p in self.parts]
        cost[edges[1:][whole]] = 0
        marks = np.concatenate([[0], np.flatnonzero(cost[1:-1] >= 0) + 1, [self.size]])
        if (gaps := np.diff(marks)).max() > STRETCH:
            for a, gap in zip(marks[:-1][gaps > STRETCH], gaps[gaps > STRETCH]):
                cost[a + STRETCH : a + gap : STRETCH] = OTHER_COST
        cost[0] = cost[-1] = 0
        at = np.flatnonzero(cost >= 0)
        chosen = plan(at.tolist(), cost[at].tolist(), self.length)
        if not last:
            chosen.pop()  # what follows may fit better
        elif (rest := chosen[-1] - chosen[-2]) & (rest - 1):
            for k in reversed(range(self.length.bit_length())):
                if rest >> k & 1 and rest & ((1 << k) - 1):
                    chosen.insert(-1, chosen[-2] + (1 << k))
        if len(chosen) > 1:
            yield from self.pieces(ids, edges, chosen)
        done, parts = chosen[-1], self.parts
        self.parts = [(key, start + max(0, done - a), n, x[max(0, done - a) :]) for (key, start, n, x), a in zip(parts, edges) if a + len(x) > done]
        self.size -= done

    def pieces(self, ids: np.ndarray, edges: np.ndarray, chosen: list[int]) -> Iterator[tuple]:
        windows = np.array(chosen)
        at = np.unique(np.concatenate([windows, edges[edges < windows[-1]]]))
        of = np.searchsorted(edges, at[:-1], side="right") - 1
        window = np.searchsorted(windows, at[:-1], side="right") - 1
        raw = memoryview(ids.tobytes())
        for a, b, p, w in zip(at[:-1].tolist(), at[1:].tolist(), of.tolist(), window.tolist()):
            key, start, n, _ = self.parts[p]
            yield key, start + a - int(edges[p]), b - a, zlib.crc32(raw[4 * a : 4 * b]), n, self.sequence + w, a - chosen[w]
        self.sequence += len(chosen) - 1


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  ``end_id`` follows each document."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    field = docs.schema[key].dataType
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        packer = Packer(tok.ends_sentence, length, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        kind = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for incoming in batches:
            kind = incoming.schema.field(0).type
            for part, data, offs in words.slices(incoming, "t"):
                ids, at = tok.encode(data, offs)
                ids = np.insert(ids, at[1:], end_id)
                at = (at + np.arange(len(at))).tolist()
                for k, a, b in zip(part.column(0).to_pylist(), at, at[1:]):
                    out.extend(packer.add(k, ids[a:b]))
                if len(out) > 20_000:
                    yield batch()
                    out.clear()
        out.extend(packer.flush(True))
        if out:
            yield batch()

    schema = f"`{key}` {field.simpleString()}, " + ", ".join(f"`{n}` bigint" for n in names[1:])
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("tie"))
    return read.repartitionByRange("k", "tie").sortWithinPartitions("k", "tie").select("k", "t").mapInArrow(rows, schema)
