"""The pipeline's stages, each against plain Python on its own input."""

import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages(spark):
    from fieldmill.llm.common import staged
    from test_operators import link_components, removed, shingle_set

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "passages", "packing"]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = staged(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= set(before)
        if name in ("quality", "toxicity"):
            wrong = [i for i in before if i in labels and (labels[i].quality == 1 if name == "quality" else labels[i].toxic == 0) != (i in ids)]
            assert len(wrong) <= 0.1 * len(before)
        if name == "near_duplicates":
            order = sorted(before)
            groups = link_components(order, [shingle_set(before[i].text, 5) for i in order], 80)
            assert ids == set(groups.values())
        if name == "passages":
            cut = removed([(i, before[i].text) for i in sorted(before)])
            assert ids == {i for i, c in cut.items() if c[0] == 0 or c[1] < c[0]}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "packing":
            assert ids == set(before)
        docs = after


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, other columns, and no rows at all."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    kind = docs.schema
    odd = [(None, None, None, None, None), (None, "", "en", "web", 0), (3, None, "en", None, None), (3, None, "en", None, None), (3, "a b", None, "web", 3)]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = docs.columns
    extra = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in odd], kind).select(names)
    mixed = docs.unionByName(docs).unionByName(extra).selectExpr("*", "1 as key", "'x' as component", "2 as score")
    for name, df, known in (("mixed", mixed, labels), ("none", docs.limit(0), labels), ("unlabelled", docs, labels.limit(0))):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        known.write.parquet(f"{folder}/labels.parquet")
        rows = pipeline.run(spark, folder).collect()
        assert bool(rows) == (name != "none")
        assert {r.doc_id for r in rows} <= {r.doc_id for r in df.select("doc_id").collect()}
