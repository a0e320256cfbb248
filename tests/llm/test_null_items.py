"""Benchmark rows without an item_id, against the query's own SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from conftest import rows_of  # noqa: E402

from storegrain.llm import decontaminate  # noqa: E402


def test_null_item_id_counts_as_one_item(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    passage = [" ".join(f"{w}{k}" for k in range(15)) for w in "abc"]
    bench = [(None, passage[0]), (None, passage[1]), (7, passage[1]), (8, passage[2]), (None, None)]
    docs = [(1, passage[0]), (2, f"x {passage[0]} y {passage[1]}"), (3, passage[2]), (4, "clean"), (5, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    out = decontaminate.op8_benchmark_decontamination(spark, str(tmp_path))
    assert rows_of(out.toPandas()) == rows_of(con.execute(decontaminate.SQL).fetchdf())
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect()}
    assert got == {1: (15, 1, True), 2: (30, 2, True), 3: (15, 1, True), 4: (0, 0, False), 5: (0, 0, False)}
