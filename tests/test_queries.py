"""Every registered query with SQL gives its rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

import fabula.plans.more  # noqa: F401
import fabula.plans.narration  # noqa: F401
import fabula.plans.tables  # noqa: F401
import fabula.plans.texts  # noqa: F401
from fabula.plans.registry import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else float(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall()), key=str)
    assert [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in g) for g in got] == want


def test_running_gate_stream(spark):
    """The stream gives what the batch gives."""
    from fabula.session import fresh_path
    from fabula.streaming import incremental as S

    path = fresh_path(spark, "gate")
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "event_id", "value").where("user_id < 20").coalesce(1)
    rows.write.parquet(path)
    streamed = S.run_available(spark, S.running_gate_stream(spark.readStream.schema(rows.schema).parquet(path), "user_id", "event_id", "value"), "append")
    batch = S.running_gate(rows, "user_id", "event_id", "value")
    assert sorted(map(tuple, streamed.select("user_id", "event_id", "accepted").collect())) == sorted(map(tuple, batch.select("user_id", "event_id", "accepted").collect()))
