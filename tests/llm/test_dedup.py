import hashlib
import re

import pytest

from sparkhop.llm import near, passages
from sparkhop.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def classes_of(sets):
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in sets):
            break
    return label


def test_near_duplicates_match_brute_force(docs, texts):
    sets = sets_of(texts)
    label = classes_of(sets)
    assert len(set(label.values())) < len(label) - 3  # there is something to find
    got = near.cluster(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_of_odd_tables(spark, docs, empty):
    assert near.cluster(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near.cluster(odd).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 0, "None", True), ("None", 2, "None", True)]


@pytest.mark.parametrize(("small", "middle"), [(8, 512), (2, 512), (2, 6)])
def test_a_large_group_of_near_copies(spark, monkeypatch, small, middle):
    """Nodes of all sizes: pairs, comparison in one task, pivots and branches."""
    import random

    for name, value in (("SMALL", small), ("MIDDLE", middle), ("LAST_DEPTH", 8)):
        monkeypatch.setattr(near, name, value)
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = {}
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 22)):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    label = classes_of(sets_of(rows))
    assert {x.doc_id: x.component_id for x in near.cluster(df).collect()} == label


def test_rounds_on_large_nodes_read_few_partitions(spark, monkeypatch):
    """Each round's links are a new spanning forest in few files, however many
    rounds there were: the driver keeps a record of each task."""
    for name, value in (("SMALL", 3), ("MIDDLE", 4), ("LAST_DEPTH", 8), ("FEW", 0)):
        monkeypatch.setattr(near, name, value)
    seen = []

    def counted(links):
        seen.append(links.rdd.getNumPartitions())
        return components(links)

    monkeypatch.setattr(near, "components", counted)
    own = [" ".join([f"w{k}" for k in range(120)] + [f"own{i // 2}x{k}" for k in range(12)] + [f"end{i}"] * (i % 2)) for i in range(24)]
    rows = dict(enumerate(own))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.doc_id: x.component_id for x in near.cluster(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == classes_of(sets_of(rows))
    assert len(seen) > 1 and max(seen) <= 4 * spark.sparkContext.defaultParallelism


def test_blocks_of_a_node_meet_each_other(spark):
    """10,000 members make 10,000 rows a block, and each two members meet."""
    members = spark.range(10_000).selectExpr("if(id < 9000, 7, 8) as node", "id")
    blocks = spark.createDataFrame([(7, 9), (8, 1)], "node bigint, blocks bigint")
    rows = near.in_blocks(members, blocks).collect()
    assert len(rows) == 9 * 9000 + 1000
    of = {}
    for r in rows:
        of.setdefault(r.id, set()).add(r.node)
    some = list(range(0, 9000, 97))
    assert all(of[a] & of[b] for a in some for b in some) and of[9500] == {8}
    sizes = {}
    for r in rows:
        sizes[r.node] = sizes.get(r.node, 0) + 1
    assert max(n for k, n in sizes.items() if k != 8) < 2300  # two of nine blocks


def test_unlike_members_of_one_node_and_hot_classes(spark, monkeypatch):
    """Nodes whose members mostly differ are compared in blocks, few shingles
    fit into a task, and a class of copies is hot: still exact."""
    for name, value in (("SMALL", 2), ("MIDDLE", 6), ("LAST_DEPTH", near.DEPTH), ("SHINGLES", 500), ("HOT", 10), ("FEW", 0)):
        monkeypatch.setattr(near, name, value)
    rows = {}
    for i in range(48):  # pairs of texts that share about 60 % with all others
        rows[i] = " ".join([f"w{k}" for k in range(120)] + [f"own{i // 2}x{k}" for k in range(36)] + ([f"end{i}"] if i % 2 else []))
    rows |= {100 + i: rows[0] for i in range(20)} | {200 + i: "" for i in range(20)} | {300 + i: None for i in range(5)}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    sets = sets_of(rows)
    label = classes_of(sets)
    assert len({label[i] for i in range(48)}) == 24
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near.cluster(df).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in rows}


def test_blocks_around_a_main_component(spark, monkeypatch):
    """Members of different components share a node; rows grow with the others'
    number times the blocks, and a node has a block and the others."""
    monkeypatch.setattr(near, "MIDDLE", 40)
    rows = [(7, i, i if i < 12 else 12, 12, 500) for i in range(512)]
    got = near.around_main(spark.createDataFrame(rows, "node long, id long, component long, main long, most long")).collect()
    assert len(got) == 500 + 12 * 25
    of, sizes = {}, {}
    for r in got:
        of.setdefault(r.id, set()).add(r.node)
        sizes[r.node] = sizes.get(r.node, 0) + 1
    assert all(of[a] & of[b] for a in range(12) for b in range(512)) and max(sizes.values()) < 2 * 40


def test_a_main_component_and_others_need_no_branch(spark, monkeypatch):
    """One large group of near copies and texts like it below the threshold."""

    def branched(members):
        raise AssertionError("the node branched")

    for name, value in (("SMALL", 2), ("MIDDLE", 16), ("FEW", 0), ("children", branched)):
        monkeypatch.setattr(near, name, value)
    rows = {}
    for i in range(60):
        rows[i] = " ".join([f"w{k}" for k in range(120)] + [f"end{i}"])
    for i in range(60, 66):  # pairs that share about 70 % with all others
        rows[i] = " ".join([f"w{k}" for k in range(100)] + [f"own{i // 2}x{k}" for k in range(24)] + [f"end{i}"])
    sets = sets_of(rows)
    label = classes_of(sets)
    assert len(set(label.values())) == 4
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near.cluster(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in rows}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 50 and len(got) == 44
    odd = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (2, 1, None), (None, 3, ""), (4, None, ""), (None, None, None)], "a bigint, b bigint, node string")
    assert sorted((r.node, r.component) for r in components(odd).collect()) == [(1, 1), (2, 1)]
    assert components(odd.limit(0)).count() == 0


def removed_of(texts):
    words = {i: WORD.findall(t or "") for i, t in sorted(texts.items())}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    gone = {i: {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)} for i, w in words.items()}
    return words, gone


@pytest.mark.parametrize("rows", [400, 3])
def test_passages_match_brute_force(docs, texts, monkeypatch, rows):
    monkeypatch.setattr(passages, "BLOCK_ROWS", rows)
    words, gone = removed_of(texts)
    assert sum(map(len, gone.values())) > 300
    got = {r.doc_id: r for r in passages.digests(docs).collect()}
    for i, w in words.items():
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest()), i


def test_overlapping_and_shifted_repeats(spark):
    """Short vocabularies give many overlapping, partly equal reaches."""
    import random

    r = random.Random(8)
    texts = {i: " ".join(r.choice("ab") for _ in range(60)) for i in range(25)} | {i: " ".join(str(r.randrange(4)) for _ in range(200)) for i in range(25, 40)}
    base = [f"w{i}" for i in range(80)]
    for i in range(40, 60):
        a = r.randrange(60)
        texts[i] = " ".join([f"p{i}"] * 3 + base[a : a + r.randrange(10, 20)] + [f"q{i}"] * 2 + base[a // 2 : a // 2 + 14])
    words, gone = removed_of(texts)
    got = {x.doc_id: x.n_removed for x in passages.digests(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {i: len(g) for i, g in gone.items()}


def test_passages_are_cut_from_texts(docs, texts):
    words, gone = removed_of(texts)
    out = passages.remove(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        want = [x for k, x in enumerate(words[r.doc_id]) if k not in gone[r.doc_id]]
        assert WORD.findall(r.text or "") == want and r.n_chars == (None if r.text is None else len(r.text)) and r.key == "extra"
        if not gone[r.doc_id]:
            assert r.text == texts[r.doc_id]


def test_passages_of_string_keys(spark):
    """Any key that Spark can order; all columns, clashing names too, stay."""
    text, own = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(20))
    rows = [("b", text, 1, "k"), ("a", f"{own} {text}", 2, "l"), ("c", f"{text} x", 3, None), (None, text, 4, "m"), ("c", None, 5, "n")]
    d = spark.createDataFrame(rows, "doc_id string, text string, n_chars bigint, key string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in passages.digests(d).collect())
    assert got == [("None", 30, 0), ("a", 50, 0), ("b", 30, 30), ("c", 0, 0), ("c", 31, 30)]
    out = passages.remove(d)
    assert out.columns == d.columns
    assert sorted((str(r.doc_id), str(r.n_chars), str(r.key)) for r in out.collect()) == [("None", str(len(text)), "m"), ("a", str(len(rows[1][1])), "l"), ("b", "0", "k"), ("c", "1", "None"), ("c", "None", "n")]


def test_sizes_of_rows_without_a_key(spark):
    """Counted again like all others', in the column's own type."""
    d = spark.createDataFrame([(None, "one é", 99), (None, None, 7), (1, "two", 5)], "doc_id bigint, text string, n_chars int")
    out = passages.remove(d)
    assert out.dtypes == d.dtypes
    assert sorted((str(r.text), r.n_chars) for r in out.collect()) == [("None", None), ("one é", 5), ("two", 3)]


def test_passages_of_odd_tables(spark, empty):
    assert passages.digests(empty).count() == 0 and passages.remove(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    odd = spark.createDataFrame([(None, text), (5, text), (5, text), (6, text)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in passages.digests(odd).collect()) == [("5", 0), ("5", 0), ("6", 20), ("None", 0)]
