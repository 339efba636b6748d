"""The pipeline and the registered queries on the smallest data."""

import duckdb
import pytest

import corpus_pipeline
from prismfold.llm.queries import ORACLES, QUERIES
from prismfold.llm.shared import read_table


def test_stages_keep_columns_and_shrink(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert bins.select("doc_id").distinct().count() == before


def test_empty_documents_pass(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


#: These return phrases and triples, not a row a document; SQL has all their rows.
OTHER_ROWS = {"op12_collocations", "op13_hard_negatives"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_ROWS))
def test_query_covers_its_table(spark, sf_dir, name):
    table = "pages" if name.startswith("op8_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[0] for r in QUERIES[name](spark, sf_dir).select(key).collect()}
    assert ids == {r[0] for r in read_table(spark, sf_dir, table).select(key).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, df.select(*columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, r))})" for r in result.fetchall())
