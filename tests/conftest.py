import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from brinelog.session import session

    conf = {"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_checkpoint_dir": tempfile.mkdtemp(prefix="spark-")}
    s = session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.fixture(scope="session")
def matches(spark, duck):
    def run(query, sql):
        df = query(spark, SF)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
        want = duck.sql(sql)
        assert sorted(want.columns) == cols
        names = ",".join(f'"{c}"' for c in cols)
        assert got == sorted(repr(r) for r in duck.sql(f"select {names} from ({sql})").fetchall())

    return run
