import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same_rows(spark_df, relation):
    """Asserts equal column names and rows, in any order."""
    got, want = spark_df.toPandas(), relation.df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
