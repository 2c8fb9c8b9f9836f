import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table as (id, text) rows."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
