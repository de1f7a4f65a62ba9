from __future__ import annotations

import pytest

import corpus_pipeline
from skylattice.llm import near_dedup, queries
from skylattice.llm.common import release
from tests.llm.test_text_operators import naive_groups, naive_lines

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = out.cache()
    assert docs.count() > 0 and out.count() == docs.count()


def test_lines_and_near_copies_against_naive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines = corpus_pipeline.drop_lines(spark, docs, SF)
    import hashlib

    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in lines.collect()} == {i: x[2] for i, x in naive_lines(rows).items()}
    groups = naive_groups(rows, 5, 80)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in groups.items() if i == c}


def test_clean_documents_stay_and_toxic_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.1").select("doc_id").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in clean) >= 0.995 * len(clean) and sum(i in kept for i in toxic) <= 0.3 * len(toxic)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here", "en", "a", 15), (3, "same words here", "en", "a", 15), (None, "same words here", None, "b", 15), (4, "SAME  words here", "en", None, 16)]
    for n in (len(rows), 0):
        docs = spark.createDataFrame([(*r, "x") for r in rows[:n]], SCHEMA + ", copies string")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).collect()
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "3", "None"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    from tests.test_queries import compare

    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name])


def test_main_text_query_is_the_article(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op10_main_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_dropped_frames_go_at_once(spark):
    """A step's files go when it is out of reach, not a step later."""
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    release(spark, wait=True)
    before = held().size()
    frame = spark.range(1000).localCheckpoint()
    assert held().size() == before + 1
    del frame
    release(spark, wait=True)
    assert held().size() == before


def test_large_tables_wait_for_what_they_drop(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(near_dedup, "VALUES", 2000)
    monkeypatch.setattr(near_dedup, "release", lambda session, wait=False: waits.append(wait))
    corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert sum(waits) > 5


def test_near_copies_go_without_a_shuffle_of_texts(spark):
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_only_the_last_stage_stays_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda session: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert [p.name for f in tmp_path.iterdir() for p in f.iterdir() if not p.name.startswith(".")] == [str(len(corpus_pipeline.STAGES) - 1)]
