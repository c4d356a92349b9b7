"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from hippospark.plans import registry
from hippospark.plans.kept import kept_table

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(float(x))
    if isinstance(x, (int, float)):
        return f"{float(x):.5f}"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and not isinstance(x, str):
        return str([plain(y) for y in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    else:
        assert rows


def test_a_kept_table_is_computed_once(spark, tmp_path):
    """Though its order is by ranges, which are found from a sample."""
    spark.range(100, numPartitions=3).write.parquet(f"{tmp_path}/t.parquet")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = lambda: spark.read.parquet(f"{tmp_path}/t.parquet").mapInArrow(counted, "id long")
    got = kept_table(spark, str(tmp_path), "t", ["t"], rows, "id")
    assert seen.value == 100 and sorted(r["id"] for r in got.collect()) == list(range(100))
    assert kept_table(spark, str(tmp_path), "t", ["t"], rows, "id").count() == 100 and seen.value == 100


@pytest.mark.parametrize(("name", "tables"), [
    # prices whose thousandth is a tie
    ("history_canvases", {"orders": "SELECT CAST(i AS BIGINT) AS o_orderkey, CAST(i % 3 AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, 500.0 + 1000.0 * i AS o_totalprice FROM range(1, 40) r(i)"}),
    # messages of one conversation beyond the eighth, and gaps between conversations
    ("message_topk", {"conversations": "SELECT CAST(i // 12 * 5 AS BIGINT) AS conv_id, CAST(i % 12 AS BIGINT) AS turn, 'user' AS role, 't' AS text FROM range(40) r(i)", "embeddings": "SELECT CAST(i AS BIGINT) AS vec_id, [CAST(i % 7 + 1 AS FLOAT), CAST(i % 5 AS FLOAT), CAST(i AS FLOAT)] AS embedding, 1 AS label FROM range(60) r(i)"}),
])
def test_query_on_odd_tables(spark, tmp_path, name, tables):
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cursor = c.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(tuple(plain(r[x]) for x in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
