"""The sequence map on hand-made tables: each row's id in the table of all chains."""

import math

import duckdb

from clonoform.operators import assign
from clonoform.plans.receptor_queries import rfu_tables, trb
from clonoform.plans.registry import ORACLE_SQL, QUERIES

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string"
REST = {"l_quantity": "1.0D", "l_extendedprice": "1.0D", "l_discount": "0.05D", "l_tax": "0.05D", "l_returnflag": "'A'", "l_shipdate": "timestamp '1995-01-01'"}


def tables(spark, path):
    rows = [
        (9, 29, 1, 1, "O"),  # no sequence
        (None, 1, 3, 1, "O"),
        (3, 1, 1, 1, "O"),
        (5, 34, 7, 1, "O"),  # doesn't start with C
        (3, 17, 5, 2, "F"),  # another chain
        (3, 1, 1, 1, "O"),  # twice
        (None, 1, 2, 1, "O"),
    ]
    spark.createDataFrame(rows, LINES).selectExpr("*", *[f"{v} AS {c}" for c, v in REST.items()]).write.parquet(f"{path}/lineitem.parquet")
    vectors = [(i, [math.sin(i * 64.0 + d * d) for d in range(64)], i % 3) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_each_row_has_its_id_and_adapter(spark, tmp_path):
    path = tables(spark, tmp_path)
    got = QUERIES["sequence_map"](spark, path)
    assert got.columns == list(assign.MAPPING)
    rows = got.orderBy("input_row_id").collect()
    assert [(r["input_row_id"], r["source_row_id"], r["v_call"], r["reference_coverage_status"] in ("covered", "below_threshold")) for r in rows] == [
        ("row_00000000", None, "TRBV3", True),
        ("row_00000001", None, "TRBV4", True),
        ("row_00000002", "301", "TRBV2", True),
        ("row_00000003", "302", "TRBV2", True),
        ("row_00000005", "501", "TRBV8", False),
        ("row_00000006", "901", "TRBV2", False),
    ]
    assert {r["source_adapter"] for r in rows} == {"fixture"}
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["sequence_map"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(want.fetchall(), key=repr) == sorted((tuple(r) for r in rows), key=repr)


def test_rows_without_an_id_have_no_id_column(spark, tmp_path):
    path = tables(spark, tmp_path)
    assert "input_row_id" not in trb(spark, path).columns and "input_row_id" not in rfu_tables(spark, path).mapping.columns
    assert trb(spark, path).count() == trb(spark, path, numbered=True).select("input_row_id").distinct().count() == 6
