import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kinweave.session import local_session

    s = local_session(8, "tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def check_sql(spark, duck, query, sql):
    df = query(spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert cols == sorted(names)
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
