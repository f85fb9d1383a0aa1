"""The registered queries of the subpackage on the smallest tables, against their SQL where they have one."""

from __future__ import annotations

import duckdb
import pytest

from quarrylens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = db.sql(QUERIES[name].sql)
    rows = QUERIES[name].run(spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_pii_surrogates", "op4_source_mix", "op5_jaccard_join", "op7_byte_bpe",
                                  "op9_quality_rules", "op10_language_mixture"])
def test_query_covers_its_table(spark, name):
    got = QUERIES[name].run(spark, FOLDER)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert ids <= every if name == "op1_secret_scan" else ids == every


def test_pipeline_stages_keep_their_word(spark, documents):
    import corpus_pipeline as p

    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    kept = p.language_stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    gone = {r.text for r in docs.exceptAll(kept).collect()}
    assert {None, "", " \t\n ", "12345 !!! ???"} <= gone and not any(len(t or "") > 3500 for t in gone)
    single = p.near_duplicate_stage(spark, kept, FOLDER)
    assert single.columns == docs.columns and single.count() < kept.count()
    assert [name for name, _ in p.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "tokens"]


def test_near_duplicates_keep_one_row_of_a_repeated_id(spark):
    from llm_samples import edited, prose

    import corpus_pipeline as p

    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (3, edited(a, 1, 0.005)), (3, edited(b, 2, 0.005)), (4, c), (5, None), (5, None), (6, prose(6, 90)), (None, prose(7, 90)),
            (None, prose(7, 90))]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in p.near_duplicate_stage(spark, docs, FOLDER).collect()]
    assert sorted(i or 0 for i, _ in kept) == [0, 1, 3, 3, 5, 6] and (1, a) in kept and (3, c) in kept
    assert {t for i, t in kept if i == 3} - {c} <= {b, rows[6][1]}


def test_pipeline_runs(spark):
    got = QUERIES["pipeline"].run(spark, FOLDER)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() > 50
