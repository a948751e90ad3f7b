import struct
import time
import wave

import pytest
from pyspark.sql import functions as F

from siltstone.operators.store import Repository, StoreError
from siltstone.operators.versions import MergeConflict
from siltstone.sources import files, registry, smart
from siltstone.streaming import watch


@pytest.fixture
def bids(tmp_path):
    for sub in ("sub-1", "sub-2"):
        folder = tmp_path / sub / "ses-a" / "eeg"
        folder.mkdir(parents=True)
        (folder / f"{sub}_ses-a_task-rest_run-01_eeg.edf").write_bytes(b"0       " + b"x".ljust(80) + b" " * 80 + b"01.02.9903.04.05" + b"256     " + b" " * 44 + b"10      " + b"1       " + b"2   ")
        (folder / f"{sub}_ses-a_task-rest_run-01_eeg.json").write_text("{}")
    (tmp_path / "participants.tsv").write_text("participant_id\tage\tsex\nsub-1\t30\tn/a\nsub-2\t41\tF\n")
    (tmp_path / "phenotype").mkdir()
    (tmp_path / "phenotype" / "mood.tsv").write_text("participant_id\tscore\nsub-1\t07\nsub-9\t3\n")
    (tmp_path / "README.md").write_text("hello")
    return str(tmp_path)


def test_bids_folder(spark, bids):
    found = files.listing(spark, bids)
    assert {r.path for r in found.collect()} >= {"participants.tsv", "README.md", "sub-1/ses-a/eeg/sub-1_ses-a_task-rest_run-01_eeg.edf"}
    made = files.bundles(found.where("dir like '%eeg'")).collect()
    assert len(made) == 2 and all(set(r.files) == {".edf", ".json"} and r.problem is None for r in made)
    people = {r.sub: r.participant.asDict() for r in files.participants(spark, bids).collect()}
    assert people == {"sub-1": {"age": 30, "sex": None}, "sub-2": {"age": 41, "sex": "F"}}
    mood = files.phenotype(spark, bids, files.participants(spark, bids)).collect()
    assert [(r.sub, r.measure, r.key, r.value) for r in mood] == [("sub-1", "mood", "score", "07")]
    assert files.documents(spark, f"{bids}/README.md").first().text == "hello"
    stored = found.where("ext = '.edf'")
    assert files.not_stored(found, stored).count() == found.count() - 2
    assert files.work_units(found).count() == 2
    head = spark.read.format("binaryFile").load(f"{bids}/sub-1/ses-a/eeg/*.edf").select(files.edf_header(F.col("content")).alias("h")).first().h
    assert (str(head.recorded), head.n_records, head.n_channels) == ("1999-02-01 03:04:05", 10, 2)
    spark.dataSource.register(registry.SubjectFolders)
    assert spark.read.format("siltstone_subjects").load(bids).where("sub = 'sub-2'").count() == 2
    rows = smart.inferred(spark, bids)
    assert {(r.sub, r.ses, r.datatype, r.same_as) for r in rows.collect()} == {("1", "a", "eeg", None), ("2", "a", "eeg", "sub-1/ses-a/eeg/sub-1_ses-a_task-rest_run-01_eeg.edf")}
    assert smart.rules_report(rows).where("what = 'sub' and rule = 'tag'").first().n == 2


def test_manifest_keeps_zeros_and_attrs(spark, tmp_path):
    (tmp_path / "m.csv").write_text('sub,ses,path,task,run,meta\n01,a,x.edf,rest,001,"{""k"": ""v""}"\n01,,,,2.0,\n')
    rows = files.manifest(spark, str(tmp_path / "m.csv")).orderBy(F.col("path").isNull()).collect()
    assert [(r.sub, r.ses, r.path, r.kind) for r in rows] == [("01", "a", "x.edf", "file"), ("01", None, None, "attrs")]
    assert rows[0].entities == {"task": "rest", "run": "001"} and rows[0].meta == {"k": "v"} and rows[1].entities == {"run": "2"}


def test_wav_and_sniffing(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(100)
        f.writeframes(struct.pack("<4h", 1, -2, 3, 4))
    df = spark.read.format("binaryFile").load(str(tmp_path / "a.wav"))
    assert files.wav_samples(df).first().samples == [1, -2, 3, 4]
    assert df.select(files.sniffed(F.lit(".xyz"), F.col("content"))).first()[0] == "wav"


def test_registry(spark, tmp_path):
    registry.register_reader("mine", lambda spark, source: spark.range(1), (".abc",))
    assert registry.reader_for("x/y.abc")(spark, "") is not None and "mine" in registry.available_readers()
    with pytest.raises(registry.UnknownReader):
        registry.reader_for("x.unknown")
    with pytest.raises(ValueError):
        registry.register_reader("bids", None)
    assert registry.storage_uri("s3://b/p", "sub-1") == "s3a://b/p/sub-1"
    for bad in ("s3://k:s@b/p", "gs://b?token=1", "ftp://x"):
        with pytest.raises(ValueError):
            registry.storage_uri(bad)
    registry.register_format(".nii.gz", int)
    registry.register_format(".gz", str)
    assert registry.decoder_for("a.NII.gz") is int and registry.decoder_for("b.gz") is str


def items(spark, *rows):
    return spark.createDataFrame([(p.split("/")[0], p, n) for p, n in rows], "sub string, path string, n long")


def content(df):
    return {r.path: r.n for r in df.collect()}


def test_repository_history(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"))
    assert repo.commit("nothing") is None
    repo.add(items(spark, ("s1/a", 1), ("s2/a", 1)))
    first = repo.commit("first")
    with pytest.raises(StoreError):
        repo.add(items(spark, ("s1/a", 2)))
    repo.add(items(spark, ("s1/a", 9), ("s1/b", 5)), existing="skip")
    assert content(repo.read(include_staged=True)) == {"s1/a": 1, "s1/b": 5, "s2/a": 1}
    second = repo.commit("second")
    assert content(repo.read(first)) == {"s1/a": 1, "s2/a": 1} and content(repo.read("main~1")) == content(repo.read(first))
    assert {(r.path, r.change) for r in repo.diff(first, second).collect()} == {("s1/b", "added")}
    repo.branch_off("side", first)
    repo.switch("side")
    repo.add(items(spark, ("s2/a", 7), ("s3/a", 3)), existing="replace")
    repo.commit("side work")
    repo.add(items(spark, ("s1/c", 4)))
    repo.commit("more side work")
    repo.switch("main")
    merged = repo.merge("side")
    assert content(repo.read()) == {"s1/a": 1, "s1/b": 5, "s1/c": 4, "s2/a": 7, "s3/a": 3}
    assert repo.merge("side") == merged
    repo.remove("s3")
    gone = repo.commit("drop")
    assert "s3/a" not in content(repo.read())
    repo.revert(gone)
    assert content(repo.read())["s3/a"] == 3
    repo.tag("v1")
    assert repo.resolve("v1") == repo.head() == repo.resolve(repo.head()[:8])
    assert [m for _, m in repo.log()][-1] == "first"
    assert repo.gc(time.time() + 1) == []


def test_merge_conflict_and_choice(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"))
    repo.add(items(spark, ("s1/a", 1)))
    repo.commit("base")
    repo.branch_off("side")
    repo.add(items(spark, ("s1/a", 2)), existing="replace")
    repo.commit("mine")
    repo.switch("side")
    repo.add(items(spark, ("s1/a", 3)), existing="replace")
    repo.commit("theirs")
    repo.switch("main")
    with pytest.raises(MergeConflict):
        repo.merge("side")
    repo.merge("side", prefer="other")
    assert content(repo.read()) == {"s1/a": 3}


def test_streams(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"))
    repo.refresh()
    repo.add(items(spark, ("s1/a", 1)))
    head = repo.commit("first")
    assert repo.refresh() and not repo.refresh()
    stream = watch.changed_subjects(watch.commits(spark, str(tmp_path / "store")))
    query = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.id, r["sub"]) for r in spark.table("seen").collect()] == [(head, "s1")]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    for name, made in (("windows", watch.window_counts(events, "ts", "1 day", "1 day", "event_type")), ("sessions", watch.session_counts(events, "ts", "1 hour", "1 day", "user_id"))):
        made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() > 0


def test_command_line(spark, tmp_path, capsys):
    from siltstone import cli

    store = str(tmp_path / "store")
    repo = Repository(spark, store)
    repo.add(items(spark, ("s1/a", 1), ("s1/b", 20)))
    first = repo.commit("first")
    repo.add(items(spark, ("s2/a", 5)))
    second = repo.commit("second")
    assert cli.main([store, "query", "n > 4", "--columns", "path,n", "--csv"]) == 0
    assert capsys.readouterr().out.split() == ["s1/b,20", "s2/a,5"]
    assert cli.main([store, "diff", first, second, "--exit-code"]) == 1
    assert cli.main([store, "query", "n ==="]) == 1
    assert "error:" in capsys.readouterr().err
    assert cli.main([store, "log", "-n", "1"]) == 0 and "second" in capsys.readouterr().out


def test_unlike_files_of_one_name_and_length_are_no_copies(spark, tmp_path):
    from siltstone.sources import smart

    for folder, byte in (("s1", b"A"), ("s2", b"B"), ("s3", b"A")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "rec.edf").write_bytes(byte * 2000)
    (tmp_path / "s3" / "other.edf").write_bytes(b"A" * 10)
    rows = {r.path: r for r in smart.inferred(spark, str(tmp_path)).collect()}
    assert rows["s2/rec.edf"].same_as is None and rows["s3/other.edf"].same_as is None
    assert (rows["s1/rec.edf"].same_as, rows["s3/rec.edf"].same_as) == ("s3/rec.edf", None)  # more stands beside it


def test_of_two_writers_one_is_told(spark, tmp_path):
    root = str(tmp_path / "store")
    one, other = Repository(spark, root), Repository(spark, root)
    one.add(items(spark, ("s1/a", 1)))
    one.commit("base")
    other.add(items(spark, ("s2/a", 2)))
    number, head = other._ref("branch", "main")
    one.add(items(spark, ("s3/a", 3)))
    one.commit("first")
    with pytest.raises(StoreError):
        other._publish({"s2": "x"}, "late", [head], number)
    assert content(one.read()) == {"s1/a": 1, "s3/a": 3} and other.status()["staged"] == ["s2"]
    other.commit("again")
    assert content(other.read()) == {"s1/a": 1, "s2/a": 2, "s3/a": 3}
    (tmp_path / "store" / "data" / "inflight").mkdir()
    assert one.gc(time.time() - 60) == [] and one.gc(time.time() + 60) == ["inflight"]


def test_many_subjects_are_one_plan(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"))
    rows = spark.range(3000).selectExpr("concat('s', id) AS sub", "concat('s', id, '/a') AS path", "id AS n")
    repo.add(rows)
    repo.commit("many")
    assert len(repo.status()["staged"]) == 0 and repo.read().count() == 3000
    assert "isin" not in repo.read()._jdf.queryExecution().toString().lower() and "INSET" not in repo.read()._jdf.queryExecution().toString()


def test_items_can_be_moved_and_removed(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "store"))
    repo.add(items(spark, ("s1/x/a", 1), ("s1/y", 2), ("s2/x", 3)))
    repo.commit("base")
    assert repo.move("s1/x", "s2/z") == 1 and repo.remove_items("s2/x") == 1
    with pytest.raises(StoreError):
        repo.move("s1/y", "s2/z")
    with pytest.raises(StoreError):
        repo.remove_items("s9")
    repo.commit("moved")
    assert content(repo.read()) == {"s1/y": 2, "s2/z/a": 1}
    assert repo.remove_items("s1") == 1 and repo.commit("gone") and content(repo.read()) == {"s2/z/a": 1}
