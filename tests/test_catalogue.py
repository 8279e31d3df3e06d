import pytest
from compare import connect, same

from inkveil.plans import catalogue, oracle

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(catalogue.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_rescan_where_a_word_covers_just_half(spark, tmp_path):
    lines = {44226: [(5, 5), (7, 41), (5, 39), (3, 21)], 103888: [(3, 22), (2, 21), (4, 40), (1, 40), (7, 32), (1, 44)], 41363: [(5, 2), (4, 30), (3, 43), (7, 13), (3, 43), (5, 20), (2, 25), (2, 16)]}
    rows = [(k, n, float(q)) for k, some in lines.items() for n, q in some]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in lines], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    same(catalogue.region_rescan(spark, str(tmp_path)), connect(tmp_path), SQL["region_rescan"])


def test_checksums_are_those_of_the_bytes(spark, sf):
    import zlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalogue.zip_checksums(spark, sf).collect():
        assert r["crc32"] == zlib.crc32(docs[r["doc_id"]].encode())
