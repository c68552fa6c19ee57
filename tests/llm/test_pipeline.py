import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tests.llm.conftest import corpus, prose  # noqa: E402
from tests.llm.test_dedup import WORD, classes_of, removed_of, sets_of  # noqa: E402
from tests.llm.test_scores import naive_base, toxic_rows  # noqa: E402
from tests.llm.test_tokens import WORDS, check_pieces  # noqa: E402

SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    toxic, labels = toxic_rows(400, 5)
    rows = [(1000 + i, t, "en", "s", len(t)) for i, t, *_ in toxic]
    rows += [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus()]
    rows += [(90, f"{prose(90, 50)} {SECRET} {prose(91, 20)}", "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1000 + i, q, b) for i, q, b in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, {r[0]: r[1] for r in rows}, {1000 + i: b for i, _, b in labels}


def test_stages_match_brute_force(spark, folder, tmp_path):
    where, before, toxic = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, held = docs.columns, [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            held.append({r.doc_id: r.text for r in docs.collect()})
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None and k in (2, 3))
    clean, single, cut, redacted = held[1:]
    assert np.mean([(i in clean) == (not b) for i, b in toxic.items()]) > 0.95 and all(clean[i] == before[i] for i in clean)
    label = classes_of(sets_of(clean))
    assert set(single) == {i for i, c in label.items() if c == i} and all(single[i] == clean[i] for i in single)
    words, gone = removed_of(single)
    assert set(cut) == set(single)
    assert all(WORD.findall(cut[i] or "") == [x for j, x in enumerate(w) if j not in gone[i]] for i, w in words.items())
    assert set(redacted) == set(cut) and SECRET in cut[90] and "[SECRET]" in redacted[90]
    assert not any(naive_base(t or "") for t in redacted.values())
    assert sum(redacted[i] != t for i, t in cut.items()) <= 2
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    check_pieces(docs.collect(), {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in redacted.items()})


def test_run_gives_all_kept_documents(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0])
    assert rows.columns[:2] == ["doc_id", "start"] and rows.select("doc_id").distinct().count() > 200


def test_stages_on_odd_tables(spark, folder):
    """Clashing keys, null keys and texts, repeated rows, an empty table."""
    where, _, _ = folder
    a, b = prose(7001, 60), prose(7002, 60)
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "t", 1), (2, a, "de", "s", 1), (None, a, None, None, None), (None, a, None, None, None), (None, None, None, None, None), (3, None, "en", "s", None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    near = sorted(map(str, stages["minhash_near_dedup"](spark, docs, where).select("doc_id", "text", "source").collect()))
    want = [(1, a, "s"), (1, b, "s"), (None, a, None), (None, a, None), (None, None, None), (3, None, "s"), (3, "", "s")]
    assert near == sorted(map(str, spark.createDataFrame(want, "doc_id bigint, text string, source string").collect()))
    for name in ("toxicity", "substring_dedup", "secret_scans"):
        out = stages[name](spark, docs, where)
        assert out.count() == 10 and out.columns == docs.columns, name
    pieces = stages["packing"](spark, docs, where).collect()
    assert sum(r.start == 0 for r in pieces) == 10 and sum(r.start + r.length == r.doc_tokens for r in pieces) == 10
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), where).count() == 0, name
