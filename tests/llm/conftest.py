import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import BENCHMARK, SCHEMA, documents


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, docs, tmp_path_factory):
    """A folder with the tables that the queries read."""
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_tables(spark, nothing, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in {"documents": SCHEMA, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)
