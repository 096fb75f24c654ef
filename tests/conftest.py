import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(spark):
    """Compare a query with its SQL on the smallest tables."""
    import math

    import duckdb
    import pandas as pd

    def rows(df):
        plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
        df = df[sorted(df.columns)]
        return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)

    def run(query, sql):
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            path = f"{SMALL}/{f}"
            path += "/*.parquet" if os.path.isdir(path) else ""
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
        got, want = rows(query(spark, SMALL).toPandas()), rows(con.execute(sql).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return run
