import duckdb
import pytest

from siltstone.operators import verify
from siltstone.plans import catalogue

DOCS = [(k, f"src{k % 3 + 3}", 10 + k) for k in range(210)]
NATIONS = [(k,) for k in range(8)]
ODD = {
    "empty texts": (DOCS + [(1001, "src4", 0), (1002, "src5", 0), (1003, "src5", None)], NATIONS),
    "underscores": ([(k, f"web_{s}", n) for k, s, n in DOCS], NATIONS),
    "no label": (DOCS + [(k, "", 5) for k in range(1000, 1210)], NATIONS),
    "slashes": (DOCS + [(k, "a/b", 5) for k in range(1000, 1210)], NATIONS),
    "no source": (DOCS + [(k, None, 5) for k in range(1000, 1210)], NATIONS),
    "no id": (DOCS + [(None, "src6", 5), (None, "zz", 0)], NATIONS),
    "nations twice": (DOCS, NATIONS + NATIONS),
}


@pytest.mark.parametrize("case", ODD)
def test_folder_check_equals_sql_on_odd_rows(spark, tmp_path, case):
    docs, nations = ODD[case]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(nations, "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("documents", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["ver05_folder_check"]).fetchall()
    got = catalogue.queries()["ver05_folder_check"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_subjects_by_path(spark):
    names = ["sub-a_b/sub-a_b_eeg.edf", "sub-a_b/sub-a_c_eeg.edf", "sub-a_b/eeg/sub-c_eeg.edf", "sub-/sub-_eeg.edf", "sub-d/eeg.edf", "sub-e_eeg.edf"]
    files = spark.createDataFrame([(p, p.rpartition("/")[2], 1) for p in names], "path string, name string, length long")
    people = spark.createDataFrame([("sub-a_b",), ("sub-d",), ("sub-e",)], "sub string")
    got = sorted((r["code"], r["location"]) for r in verify.folder(files, people).collect())
    assert got == [("absent_subject", "sub-e"), ("other_subject", names[2]), ("other_subject", names[1]), ("unlisted_subject", "sub-")]
