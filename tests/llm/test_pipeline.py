import importlib
import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert out.count() <= n
            assert out.where("n_chars <> char_length(text)").count() == 0 or k in (0,)
            if name.startswith(("line", "suffix")):
                assert out.count() == docs.count()
            n = out.count()
            docs = out
        else:
            assert out.select("doc_id").distinct().count() == n


def test_stages_with_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        if name.startswith(("line", "suffix")):
            assert out.count() == len(odd_rows)
    empty = docs.where("false")
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0, name


def test_ngram_stage_keeps_one_of_each_group(spark, documents):
    base = " ".join(f"w{i}" for i in range(80))
    docs = documents([(5, base), (3, base + " x"), (9, "other text here"), (8, None), (None, base)]).select("doc_id", "text", "lang", "source", "n_chars")
    out = dict(pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [3, 8, 9]


def test_entry_lists_the_queries():
    entry = importlib.import_module("__spark_entry__")
    assert [n for n in entry.queries() if n.startswith("op")] == list(importlib.import_module("panelforge.llm.queries").QUERIES)
    assert "pipeline" in entry.queries()
