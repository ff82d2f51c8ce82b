import duckdb
import __spark_entry__ as entry
from scholarmill.plans import catalogue

DATA = "/root/testdata/sf0.01"


def test_every_part_is_there():
    assert "bm25_top" in catalogue.queries() and catalogue.oracle_sql().keys() <= catalogue.queries().keys()
    assert catalogue.queries().items() <= entry.queries().items()


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_oracles(spark):
    for name, sql in catalogue.oracle_sql().items():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        assert [tuple(r) for r in catalogue.queries()[name](spark, DATA).collect()] == con.execute(sql).fetchall()
