import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_native
import test_neardup
import test_substrings

import corpus_pipeline
from loomlens.llm import common as C
from loomlens.llm import idfiles, packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark):
    """Each stage's input and output, written and read again."""
    docs, out = C.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(path := idfiles.shared_path(spark, f"test-{name}"))
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_all_but_the_last_return_documents(written):
    for before, after in written[:-1]:
        assert after.dtypes == before.dtypes


def test_toxicity(spark, written):
    before, after = map(texts, written[0])
    labels = {r.doc_id: r.toxic for r in C.table(spark, SF, "labels").collect()}
    clean = [i for i in before if labels.get(i) == 0]
    toxic = [i for i in before if labels.get(i) == 1]
    assert set(after.items()) <= set(before.items())
    assert sum(i in after for i in clean) >= 0.99 * len(clean) and sum(i not in after for i in toxic) >= 0.6 * len(toxic)  # 51 toxic labels teach little


def test_one_of_each_group_stays(written):
    before, after = map(texts, written[1])
    want = test_neardup.brute(sorted(before.items()))
    assert set(after) == {i for i, (_, _, kept) in want.items() if kept}


def test_passages_are_cut_out(written):
    before, after = map(texts, written[2])
    want = {r[0]: r for r in test_substrings.brute(sorted(before.items()))}
    assert set(after) == set(before)
    for i, t in after.items():
        kept = want[i][1] - want[i][2]
        assert kept - 8 * want[i][3] <= len(t.encode()) <= kept
        assert (t == before[i]) == (want[i][2] == 0)
    assert any(r[2] for r in want.values())


def test_contaminated_documents_go(spark, written):
    before, after = map(texts, written[3])
    items = [(r.item_id, r.text) for r in C.table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in test_native.brute(sorted(before.items()), items) if r[5]}
    assert set(after) == set(before) - hit


def test_run_packs_what_is_left(spark, written):
    docs, pieces = written[4]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == pieces.columns == packing.pack(docs.limit(1)).columns
    by_doc = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert by_doc(got) == by_doc(pieces) == {r.doc_id: r.doc_tokens for r in pieces.collect()}
    assert set(by_doc(got)) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert docs.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_one_row_of_each_group_whatever_its_id(spark):
    long, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [
        (None, long, "n", None), (5, long, "x", 1), (5, other, "y", 2), (7, other + " c", "z", 3), (9, long, "w", 4),  # 5 stands for two texts
        (None, "c d e f g h", "p", 5), (None, "c d e f g h", "q", 6), (11, "alone it stands here now", "r", 7), (12, None, "s", 8), (13, None, "s", 8), (-3, "minus three is an id too", "t", 9),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, n, 1) for i, t, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(3), SF)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text[:3] if r.text else None) for r in got.collect()), key=str)
    assert kept == sorted([(5, "a0 "), (5, "b0 "), (None, "c d"), (11, "alo"), (12, None), (13, None), (-3, "min")], key=str)


def test_columns_with_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a b " * 90, 3, 4, "x", "y", 9), (2, "a b " * 90 + "z", 3, 4, "x", "y", 9)], "doc_id long, text string, k1 int, k2 int, _spans string, window string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() == 2
