from collections import Counter

import duckdb
import pytest

from phrasedex.llm.mixing import OP10_SQL, emit_copies, mix, op10_mix_sources

from .conftest import SF


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duck.sql(f"SELECT doc_id, size, source_size, target, taken, copies FROM ({OP10_SQL})").fetchall())
    assert rows_of(op10_mix_sources(spark, SF)) == want


def test_targets_copies_and_reruns(spark):
    docs = [(i, "w " * (1 + i % 40), f"s{i % 5}" if i % 5 else None) for i in range(1500)] + [(5000, "a b", "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(df).toPandas()
    assert rows_of(mix(df)) == sorted(map(tuple, got.itertuples(index=False)))
    assert (got["taken"] <= 3 * got["size"]).all()
    # Weights by code point, null last: s1 1, s2 2, s3 3, s4 1, tiny 2 (stopped at 3 times its size), null 3.
    total = got["size"].sum()
    by = {s: g for s, g in got.groupby("source_size")}
    assert by[2]["target"].iloc[0] == 6
    for g in by.values():
        assert g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-9
    sums = got.drop_duplicates("source_size")["target"].sum()
    assert sums <= total * (1 + 1e-9)
    for _, g in got[got["source_size"] > 2].groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.02 * g["target"].iloc[0] + 40


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " \t", "a")], [(None, "a b", "x"), (1, "c", "x")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "'z' as cls")
    got = mix(df).collect()
    assert len(got) == len(rows)
    if rows and rows[0][1] in (None, ""):
        assert all(r["size"] == 0 and r["taken"] == 0 and r["target"] == 0 for r in got)


def test_repeated_rows_and_emitted_copies(spark):
    df = spark.createDataFrame([(7, "a b c", "x")] * 9, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == 9 and sum(r["taken"] for r in got) == 27
    one = spark.createDataFrame([(i, "w " * 10, "x" if i < 10 else "y") for i in range(30)], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["copies"] for r in mix(one).collect()}
    out = emit_copies(one)
    assert out.columns == one.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize(
    "rows",
    [
        [(7, "a b c", "x")] * 9,
        [(None, "a b c", "x")] * 9,
        [(7, "a b", "x"), (7, "c d e", "x"), (7, "c d f", "y"), (None, "g", "x"), (None, "h i", None), (1, "j k l m", None), (2, None, "x"), (2, "", "y")],
    ],
)
def test_emitted_rows_of_repeated_and_null_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = emit_copies(df).collect()
    assert sum(len((r["text"] or "").split()) for r in out) == sum(r["taken"] for r in mix(df).collect())
    emitted, given = Counter(map(tuple, out)), Counter(rows)
    assert set(emitted) <= set(given) and all(n <= 3 * given[r] for r, n in emitted.items())
