import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.plans import catalogue


def test_byte_size_up_to_the_largest_unit(spark):
    n = [0, 1023, 1024, 1280, 1792, 1024**2 - 1, 1024**2, 1024**3 - 1, 1024**3, 17513 * 63775, 5 * 1024**4, None]
    rows = spark.createDataFrame([(x,) for x in n], "n long")
    got = [tuple(r) for r in rows.select(*[text.byte_size(F.col("n"), *unit) for unit in ((), ("MB",), ("KB",))]).collect()]
    assert [r[0] for r in got] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1024.0 KB", "1.0 MB", "1024.0 MB", "1.0 GB", "1.0 GB", "5120.0 GB", None]
    assert [r[1] for r in got[6:]] == ["1.0 MB", "1024.0 MB", "1024.0 MB", "1065.2 MB", "5242880.0 MB", None]
    assert [r[2] for r in got[5:9]] == ["1024.0 KB", "1024.0 KB", "1048576.0 KB", "1048576.0 KB"]
    with pytest.raises(KeyError):
        text.byte_size(F.col("n"), "TB")


def test_byte_size_query_equals_sql_beyond_a_gb(spark, tmp_path):
    rows = [(k, n) for k, n in ((0, 5), (17513, 63775), (1, 1024**3), (51281, 122698), (2**20, 2**20), (3, 11220973828055587), (7, None))]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["scl08_byte_size"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(catalogue.oracle_sql()["scl08_byte_size"]).fetchall())
