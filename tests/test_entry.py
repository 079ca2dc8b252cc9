"""Driver contract."""

import __spark_entry__ as E
from oracle_sql import ORACLE_SQL


def test_keys_match():
    assert set(ORACLE_SQL) == set(E._QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "doc_id", "n_matches"]
    assert df.count() > 0


def test_no_python_udf_in_search_plans(spark):
    for name, fn in E._QUERIES.items():
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert "PythonUDF" not in plan and "EvalPython" not in plan, name


def test_single_phrase_docs_without_an_item(spark, tmp_path):
    docs = spark.read.parquet(f"{E.SMOKE_DIR}/documents.parquet").limit(20)
    bench = spark.read.parquet(f"{E.SMOKE_DIR}/benchmark.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = E.q_single_phrase_docs(spark, str(tmp_path))
    assert got.columns == ["query_id", "doc_id", "n_matches"] and got.collect() == []
