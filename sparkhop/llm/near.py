"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Equal sets are one class and
stand in the join once.  ``TREES`` independent trees branch the classes: a node
is a path of minwise tokens, and a class is in the node if its set has those
minwise tokens.  All trees start at depth ``DEPTH``, each with minwise functions
of its own; two sets of similarity s share a node at depth d with probability
s**d in each tree, so at the threshold of 0.75 a pair is missed with probability
5e-6, and a little more (up to 3e-5) where it is only found below nodes that
branch.

Nodes are compared exhaustively: first all pairs by their signatures, then those
that agree in ``LOOSE`` of ``TOKENS`` places (4.5 standard deviations below the
threshold) on the full sets.  Nodes of up to ``SMALL`` members send pairs, which
are confirmed once for all trees; nodes of up to ``MIDDLE`` are compared inside
one task, which sends a spanning forest of the links it has confirmed.  A larger
node compares its members with one pivot.  Then only members of different
components need comparing: if such pairs are few, they are compared; if all but
``MIDDLE`` / 2 members are of one component, it is dealt into blocks and each is
compared together with those others; else the node branches by selected tokens.
What is still large at ``LAST_DEPTH``, and any
node whose sets are too large for one task, is dealt into blocks, and each two
blocks are compared like a node: m members make m times the number of blocks as
rows, never their pairs.  So nothing is capped, and no task holds more than
``MIDDLE`` members or about ``SHINGLES`` shingles (one longer text aside).

Defined results: null and empty texts, and texts without words, have the empty
set and are linked with nothing; texts of fewer words than a shingle have their
whole word sequence as one; repeated rows are one class; a row without a key
stays alone (null component); an empty table gives no rows.  Key and text alone
are read, so other columns' names cannot clash.

The driver's memory: a step's plans, tasks and shuffles are garbage when its rows
are written, but the driver's heap grows while none of it is collected, so the
first steps and each step of a loop (``compacted``) end with a collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import checkpointed, collect_garbage, compacted
from .components import components

WORDS = 5
PERCENT = 75
TOKENS = 128
TREES = 32
DEPTH = 4
#: Members up to which a node sends pairs, and up to which one task compares it.
SMALL, MIDDLE = 8, 2048
#: Pairs of different components, per member, that are few.
FEW = 4
#: Depth from which large nodes are dealt into blocks, not branched further.
LAST_DEPTH = 18
#: Shingles whose texts are compared inside one task.
SHINGLES = 4_000_000
#: A class of at least 1 / HOT of all rows gets its result by a broadcast of at
#: most HOT rows, so no task joins all its copies.
HOT = 1000
LOOSE = 0.57

_MULTIPLY = words.mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = words.mix(np.arange(1001, 1001 + TOKENS, dtype=np.uint64))
_PLACES = np.random.default_rng(7).permutation(TOKENS).reshape(TREES, DEPTH)  # each place in one tree


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, by row and hash."""
    w = words.Words(data, offs, lower=True)
    h = w.hashes()
    g, at = words.grams(h, w.doc, WORDS)
    row = w.doc[at]
    size = np.diff(w.first)
    for n in range(1, WORDS):  # whole sequences
        short = np.flatnonzero(size == n)
        if len(short):
            seq = np.full(len(short), np.uint64(n))
            for k in range(n):
                seq = words.mix(seq * np.uint64(0xD1342543DE82EF95) + h[w.first[short] + k])
            g, row = np.concatenate([g, seq]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], row[new]


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_a, set_b, tokens) of each row; the set's two hashes
    and its minwise tokens are null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, text):
                g, row = shingles(data, offs)
                n = np.bincount(row, minlength=part.num_rows)
                some = n > 0
                start = (np.cumsum(n) - n)[some]
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                tokens: list[bytes | None] = [None] * len(n)
                if len(start):
                    a[some] = np.add.reduceat(words.mix(g), start)
                    b[some] = np.add.reduceat(words.mix(g + np.uint64(0x632BE59BD9B4E019)), start)
                    least = np.stack([np.minimum.reduceat(g * m + c, start) >> np.uint64(32) for m, c in zip(_MULTIPLY, _ADD)], 1).astype("<u4")
                    for i, t in zip(np.flatnonzero(some).tolist(), least):
                        tokens[i] = t.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(a.view(np.int64), mask=~some), pa.array(b.view(np.int64), mask=~some), pa.array(tokens, pa.binary())], names=[key, "n_shingles", "set_a", "set_b", "tokens"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, n_shingles bigint, set_a bigint, set_b bigint, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64)


def roots(classes: DataFrame) -> DataFrame:
    """(node, id) of each class (id, tokens) in each tree at depth DEPTH."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = batch.column(0), _tokens(batch.column(1))
            if not len(t):
                continue
            for tree, places in enumerate(_PLACES):
                node = np.full(len(t), np.uint64(tree + 1))
                for p in places:
                    node = words.mix(node * np.uint64(0xD1342543DE82EF95) + t[:, p])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), ids], names=["node", "id"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "tokens").mapInArrow(rows, f"node bigint, id {kind}")


def children(members: DataFrame) -> DataFrame:
    """(node, id) of the grandchildren of each (node, id, tokens): a node has
    two branches, each by the token at a place that the node selects, and both
    branch again; two levels a round halve the number of rounds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, ids, t = batch.column(0).to_numpy().view(np.uint64), batch.column(1), _tokens(batch.column(2))
            if not len(t):
                continue
            row = np.arange(len(t))
            for branch in range(4):
                node = parent
                for turn in (branch & 1, branch >> 1):
                    salt = words.mix(node + np.uint64(turn + 1))
                    node = words.mix(salt + t[row, (salt % np.uint64(TOKENS)).astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), ids], names=["node", "id"])

    kind = members.schema["id"].dataType.simpleString()
    return members.select("node", "id", "tokens").mapInArrow(rows, f"node bigint, id {kind}")


def _shared(rows: DataFrame) -> DataFrame:
    """(node, id, n) of nodes that have n > 1 members."""
    several = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(several, "node")


def loose(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in LOOSE of the places."""
    a = classes.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = classes.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_tokens(batch.column(2)) == _tokens(batch.column(3))).mean(1)
                yield batch.select([0, 1]).filter(pa.array(same >= LOOSE))

    kind = classes.schema["id"].dataType.simpleString()
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(rows, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; texts: (id, text)."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in words.slices(batch, "ta"):
                n = part.num_rows
                ga, ra = shingles(data, offs)
                keep = np.zeros(n, bool)
                at = 0
                for other, data_b, offs_b in words.slices(part, "tb"):
                    m = other.num_rows
                    gb, rb = shingles(data_b, offs_b)
                    mine = (ra >= at) & (ra < at + m)
                    g, r = np.concatenate([ga[mine], gb]), np.concatenate([ra[mine] - at, rb])
                    order = np.lexsort((g, r))
                    g, r = g[order], r[order]
                    twice = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
                    inter = np.bincount(r[1:][twice], minlength=m)
                    union = np.bincount(r, minlength=m) - inter
                    keep[at : at + m] = (100 * inter >= percent * union) & (union > 0)
                    at += m
                yield part.select([0, 1]).filter(pa.array(keep))

    kind = texts.schema["id"].dataType.simpleString()
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(rows, f"a {kind}, b {kind}").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole nodes, from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        if cut or held and held[-1].column(0)[-1].as_py() != node[0]:
            first = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            if first.num_rows:
                yield from first.to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bounds(node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))


def sketched(members: DataFrame) -> DataFrame:
    """Candidates of whole nodes of (node, id, tokens): rows (a, b) for small
    nodes, rows (node, a) of members that have a candidate for middle ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            node, ids = batch.column(0).to_numpy(), batch.column(1)
            t = _tokens(batch.column(2)).astype(np.uint32)
            edge = _bounds(node)
            size = np.repeat(np.diff(edge), np.diff(edge))
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, SMALL):
                at = np.flatnonzero((node[d:] == node[:-d]) & (size[d:] <= SMALL))
                for part in range(0, len(at), 4096):
                    i = at[part : part + 4096]
                    i = i[(t[i] == t[i + d]).mean(1) >= LOOSE]
                    x.append(i), y.append(i + d)
            i, j = np.concatenate(x), np.concatenate(y)
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), ids.take(pa.array(i)), ids.take(pa.array(j))], names=["node", "a", "b"])
            active = []
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > SMALL:
                    near = np.zeros(b - a, bool)
                    for k in range(a, b - 1):
                        same = (t[k + 1 : b] == t[k]).mean(1) >= LOOSE
                        if same.any():
                            near[k - a] = True
                            near[k + 1 - a :] |= same
                    active.append(np.flatnonzero(near) + a)
            if active:
                i = np.concatenate(active)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), ids.take(pa.array(i)), pa.nulls(len(i), ids.type)], names=["node", "a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    placed = members.select("node", "id", "tokens").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(rows, f"node bigint, a {kind}, b {kind}")


def _forest(column: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Tree edges that connect what links connect, among sets given as (column,
    row) entries by row, with their sizes.  Each set that is reached is compared
    with all sets that are not yet; those go out of the entries as they are."""
    out, n = [], len(size)
    start = np.searchsorted(row, np.arange(n + 1))
    fresh, mark = np.ones(n, bool), np.zeros(int(column.max()) + 1 if len(column) else 0, bool)
    open_column, open_row = column, row
    for root in range(n):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            i = todo.pop()
            mine = column[start[i] : start[i + 1]]
            mark[mine] = True
            inter = np.bincount(open_row[mark[open_column]], minlength=n)
            mark[mine] = False
            new = np.flatnonzero(fresh & (inter > 0) & (100 * inter >= percent * (size[i] + size - inter)))
            if len(new):
                fresh[new] = False
                out += [(i, int(j)) for j in new]
                todo += new.tolist()
                left = fresh[open_row]
                open_column, open_row = open_column[left], open_row[left]
    return out


def compared(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) inside whole nodes of (node, id, text), confirmed on the
    full sets: a spanning forest of each node's links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            ids, edge = batch.column(1), _bounds(batch.column(0).to_numpy())
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a < 2:
                    continue
                hashes, rows_of, at = [], [], 0
                for part, data, offs in words.slices(batch.slice(a, b - a), "text"):
                    g, r = shingles(data, offs)
                    hashes.append(g), rows_of.append(r + at)
                    at += part.num_rows
                g, r = np.concatenate(hashes), np.concatenate(rows_of)
                size = np.bincount(r, minlength=b - a)
                _, column, often = np.unique(g, return_inverse=True, return_counts=True)
                shared = often[column] > 1
                pairs = _forest(column[shared], r[shared], size, percent)
                if pairs:
                    i, j = (pa.array([p[k] + a for p in pairs]) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([ids.take(i), ids.take(j)], names=["a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    placed = members.select("node", "id", "text").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(rows, f"a {kind}, b {kind}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def in_blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, id) rows in which each two of a node's blocks make a node; those
    of one block stay.  ``blocks``: (node, blocks) with at least one each."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = members.select("node", "id").join(blocks, "node").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    both = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return placed.select(F.when(F.col("blocks") == 1, F.col("node")).otherwise(both).alias("node"), "id")


def around_main(members: DataFrame) -> DataFrame:
    """(node, id) rows of nodes (node, id, component, main, most) in which each
    block of the ``most`` members of the main component makes a node with all
    other members."""
    blocks = F.ceil(2 * F.col("most") / MIDDLE).cast("int")
    own = F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    placed = F.explode(F.when(F.col("component") == F.col("main"), own).otherwise(F.sequence(F.lit(0), blocks - 1)))
    return members.select("node", "id", placed.alias("own")).select(F.xxhash64("node", "own").alias("node"), "id")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row."""
    signed = checkpointed(signatures(docs, key, text))
    usable = signed.where(F.col("set_a").isNotNull() & F.col(key).isNotNull())
    grouped = usable.groupBy("set_a", "set_b").agg(F.min(key).alias("id"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(grouped)
    nodes = checkpointed(_shared(roots(classes)))
    wanted = nodes.select("id").distinct()
    texts = checkpointed(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted, "id", "left_semi"))
    sketch = checkpointed(classes.join(wanted, "id", "left_semi").select("id", "tokens", "size"))
    collect_garbage(docs.sparkSession)
    links, depth = [], DEPTH

    def test(pairs: DataFrame) -> DataFrame:
        return confirmed(loose(pairs, sketch), texts)

    def whole(inner: DataFrame) -> DataFrame:
        """Links inside nodes (node, id) that one task can hold."""
        found = compacted(sketched(inner.join(sketch.select("id", "tokens"), "id")))
        small = confirmed(_ordered(found.where("node is null"), "a", "b"), texts)
        middle = found.where("node is not null").select("node", F.col("a").alias("id"))
        blocks = middle.join(sketch.select("id", "size"), "id").groupBy("node").agg(F.ceil(2 * F.sum("size") / SHINGLES).alias("blocks"))
        blocks = blocks.select("node", F.when(F.col("blocks") <= 2, F.lit(1)).otherwise(F.col("blocks")).alias("blocks"))
        return compacted(small.unionByName(compared(in_blocks(middle, blocks).join(texts, "id"))))

    while True:
        links.append(whole(nodes.where(F.col("n") <= MIDDLE)))
        large = nodes.where(F.col("n") > MIDDLE)
        if large.isEmpty():
            break
        if depth == DEPTH:  # later rounds read the large nodes' members alone
            wanted = large.select("id").distinct()
            texts, sketch = (compacted(f.join(wanted, "id", "left_semi")) for f in (texts, sketch))
        pivot = large.groupBy("node").agg(F.min_by("id", F.xxhash64("id")).alias("y"))
        links.append(compacted(test(_ordered(large.join(pivot, "node").where("id <> y"), "id", "y"))))
        label = components(_union(links))
        links = [label.select(F.col("node").alias("a"), F.col("component").alias("b"))]  # connects what all links so far do
        members = large.join(label, large.id == label.node, "left").select(large.node, "id", F.coalesce("component", "id").alias("component"))
        parts = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
        sums = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max_by("component", "n").alias("main"), F.max("n").alias("most"))
        few = (F.col("n") * F.col("n") - F.col("squares")) / 2 <= FEW * F.col("n")
        members = compacted(members.join(sums.where("squares < n * n").select("node", "n", "main", "most", few.alias("few")), "node"))
        minor = members.where("few and component <> main").select("node", F.col("id").alias("x"), F.col("component").alias("cx"))
        every = members.where("few").select("node", F.col("id").alias("y"), F.col("component").alias("cy"))
        links.append(compacted(test(_ordered(minor.join(every, "node").where("cx <> cy"), "x", "y"))))
        together = F.col("n") - F.col("most") <= MIDDLE // 2
        single = members.where(~F.col("few") & together)
        if not single.isEmpty():
            links.append(whole(around_main(single)))
        wide = members.where(~F.col("few") & ~together)
        if wide.isEmpty():
            break
        if depth >= LAST_DEPTH:
            links.append(whole(in_blocks(wide, wide.select("node", F.ceil(2 * F.col("n") / MIDDLE).alias("blocks")).distinct())))
            break
        nodes = compacted(_shared(children(wide.join(sketch, "id").select("node", "id", "tokens"))))
        depth += 2
    label = components(_union(links)).withColumnRenamed("node", "id")
    named = classes.select("set_a", "set_b", "id", "copies").join(label, "id", "left").select("set_a", "set_b", "copies", F.coalesce("component", "id").alias("component_id"))
    return _named(signed.select(key, "n_shingles", "set_a", "set_b"), named, key)


def _named(signed: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Rows with the component of their class.  Rows of hot classes get it from
    a broadcast; they and rows without a class go through the join under keys of
    their own, which match nothing and spread."""
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * HOT >= F.greatest(F.lit(total), F.lit(HOT))
    held = named.where(hot).select(F.col("set_a").alias("ha"), F.col("set_b").alias("hb"), F.col("component_id").alias("hot"))
    rows = signed.join(F.broadcast(held), (F.col("set_a") == F.col("ha")) & (F.col("set_b") == F.col("hb")), "left")
    open_ = F.col("hot").isNull() & F.col("set_a").isNotNull()
    rows = rows.select(key, "n_shingles", "hot", open_.alias("open"), F.when(open_, F.col("set_a")).otherwise(F.monotonically_increasing_id()).alias("ja"), F.when(open_, F.col("set_b")).otherwise(F.lit(0)).alias("jb"))
    cold = named.where(~hot).select(F.lit(True).alias("open"), F.col("set_a").alias("ja"), F.col("set_b").alias("jb"), "component_id")
    out = rows.join(cold, ["ja", "jb", "open"], "left")
    own = F.when(F.col(key).isNotNull(), F.coalesce("hot", "component_id", F.col(key)))
    return out.select(key, "n_shingles", own.alias("component_id"), F.coalesce(own == F.col(key), F.lit(True)).alias("kept"))
