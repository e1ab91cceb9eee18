"""Queries against their SQL where several parts have one symbol id, as happens in tables of more than a million parts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_queries import SF, TABLES, shown

#: Keys of parts that are this far apart give equal places, names and kinds.
APART = 3 * 8 * 5 * 13 * 97 * 7
NAMES = ["graph_answer_edges", "postings_intersect", "get_symbols", "postings_build", "snapshot_merge", "upsert_replace", "workspace_dedup"]


@pytest.fixture(scope="module")
def twins(spark, tmp_path_factory):
    """The smallest tables with every part twice, of other brands, and a third of them three times."""
    folder = tmp_path_factory.mktemp("twins")
    part = spark.read.parquet(f"{SF}/part.parquet")
    moved = lambda i: part.withColumn("p_partkey", F.col("p_partkey") + i * APART)
    other = moved(1).withColumn("p_brand", F.concat(F.lit("Brand#"), (F.col("p_partkey") % 9).cast("string")))
    part.unionByName(other).unionByName(moved(2).filter("p_partkey % 3 = 0")).write.parquet(f"file://{folder}/part.parquet")
    for t in TABLES:
        if t != "part":
            (folder / f"{t}.parquet").symlink_to(Path(SF) / f"{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_where_ids_repeat(spark, twins, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{twins}/{t}.parquet{'/*.parquet' if t == 'part' else ''}'")
    df = __spark_entry__.queries()[name](spark, twins)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert shown(df.collect(), df.columns) == shown(want.fetchall(), want.columns)
