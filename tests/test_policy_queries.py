"""Policies over documents with blank and missing columns give the rows of their SQL."""

from itertools import product

import duckdb
import pytest
from compare import rows

from lamplight.plans import corpus_queries, registry  # noqa: F401


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Documents of all ids of a cycle with texts, languages and sources that are null, empty, blank or begin with forty spaces."""
    home = tmp_path_factory.mktemp("odd")
    texts = [None, "", "  \n\t", "\u3000\x1c", " " * 40 + "late", "a text"]
    odd = list(product(texts, [None, "", "en"], [None, "", " ", "src1"]))
    made = [(i, *odd[i % len(odd)]) for i in range(40 * len(odd))] + [(None, "a text", "en", "src1"), (None, None, None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    df.write.parquet(f"{home}/documents.parquet")
    return str(home)


@pytest.mark.parametrize("name", ["policy_document", "policy_eligibility"])
def test_blank_columns_give_the_rows_of_sql(name, spark, odd_documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_documents}/documents.parquet/*.parquet')")
    assert rows(registry.QUERIES[name](spark, odd_documents).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())
