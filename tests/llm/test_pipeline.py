"""The stages, each on what the one before kept, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kursbuch.llm.common import stage

from .conftest import make_docs


@pytest.fixture()
def folder(spark, tmp_path, corpus):
    rnd = random.Random(1)
    junk = [(700 + i, " ".join(f"w{rnd.randrange(50)}%%%" for _ in range(40)), "s1") for i in range(80)]
    fine = [r for r in corpus if r[0] is not None]
    make_docs(spark, fine + junk).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, t, _ in fine if t and t.strip()] + [(i, 0, 0) for i, _, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, folder), "t")
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    good, exact, near, mixed = kept
    assert len([i for i in good if i >= 700]) < 8 and good > exact > near >= mixed
    assert {160} == {i for i in near if 160 <= i < 220}
    assert all(docs.groupBy("doc_id").count().agg(F.max("count") <= 2).first())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and "token_ids" in last.columns
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated ids with other texts, no labels, no rows: nothing fails and nothing else is lost."""
    say = lambda k: " ".join(f"word{(k * 31 + i) % 97}x{(k * 7 + i) % 13}" for i in range(30))
    rows = [(1, say(1), "a"), (2, say(1) + " more", "a"), (2, say(2), "b"), (None, say(3), None), (None, None, None), (5, "", "b"), (5, None, "b"), (6, say(6), "b"), (6, say(6), "b")]
    for name, held in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        make_docs(spark, held).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        near = stage(corpus_pipeline.near_stage(spark, corpus_pipeline.exact_stage(spark, docs, folder), folder), "t")
        texts = {(r["doc_id"], r["text"]) for r in near.collect()}
        assert texts >= {(1, say(1)), (2, say(2)), (None, say(3)), (6, say(6))} and (2, say(1) + " more") not in texts if held else not texts
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = stage(f(spark, docs, folder), "t")
        assert docs.columns == near.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
