import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.sources import bids, decode, registry


@pytest.fixture
def folder(tmp_path):
    for sub in ("sub-1", "sub-2"):
        at = tmp_path / sub / "ses-a" / "eeg"
        at.mkdir(parents=True)
        stem = f"{sub}_ses-a_task-rest_eeg"
        (at / f"{stem}.edf").write_bytes(b"x" * 100)
        (at / f"{stem}.json").write_text(json.dumps({"Gain": 2, "Note": sub}))
        (at / f"{sub}_ses-a_task-rest_events.tsv").write_text("onset\n1\n")
        (tmp_path / sub / f"{sub}_sessions.tsv").write_text("session_id\tdate\nses-a\t2020-01-02\n")
    (tmp_path / "task-rest_eeg.json").write_text(json.dumps({"Gain": 1, "Line": 50}))
    (tmp_path / "participants.tsv").write_text("participant_id\tage\nsub-1\t30\nsub-2\tn/a\n")
    (tmp_path / "samples.tsv").write_text("sample_id\tparticipant_id\ttype\ns1\tsub-1\tblood\n")
    (tmp_path / "dataset_description.json").write_text('{"Name": "n"}')
    (tmp_path / "README").write_text("hello")
    (tmp_path / "phenotype").mkdir()
    (tmp_path / "phenotype" / "mood.tsv").write_text("participant_id\tscore\nsub-1\t07\nsub-9\t1\n")
    (tmp_path / "derivatives" / "clean" / "sub-1" / "eeg").mkdir(parents=True)
    (tmp_path / "derivatives" / "clean" / "sub-1" / "eeg" / "sub-1_desc-clean_eeg.edf").write_bytes(b"y" * 10)
    (tmp_path / "stray.bin").write_bytes(b"123")
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "participants.json").write_text("{}")
    return str(tmp_path)


def test_scan_takes_every_file(spark, folder):
    rows = {r.path: r for r in bids.scan(spark, folder).collect()}
    item = rows["sub-1/ses-a/eeg/sub-1_ses-a_task-rest_eeg"]
    assert (item.sub, item.kind, item.ses, item.datatype, item.suffix, item.n_bytes) == ("sub-1", "recording", "ses-a", "eeg", "eeg", 100)
    assert json.loads(item.meta) == {"Gain": "2", "Line": "50", "Note": "sub-1"} and item.problem is None
    assert rows["sub-2/ses-a/eeg/sub-2_ses-a_task-rest_events"].kind == "table"
    made = rows["sub-1/derivatives/clean/eeg/sub-1_desc-clean_eeg"]
    assert (made.prefix, made.sub) == ("derivatives/clean", "sub-1")
    assert json.loads(rows["sub-1"].meta) == {"age": "30"} and json.loads(rows["sub-2"].meta) == {}
    assert json.loads(rows["sub-1/ses-a"].meta) == {"date": "2020-01-02"}
    assert json.loads(rows["sub-1/phenotype/mood"].meta) == {"score": "07"}
    assert "sub-9/phenotype/mood" not in rows
    assert json.loads(rows["sub-1/samples/s1"].meta) == {"type": "blood"}
    assert json.loads(rows[""].meta) == {"Name": "n"} and json.loads(rows["README"].meta)["text"] == "hello"
    assert {p for p, r in rows.items() if r.kind == "file"} == {"stray.bin", "other.json"}
    assert not bids.scan(spark, folder, include_derivatives=False).where("prefix is not null").count()
    assert {r.sub for r in bids.scan(spark, folder, subjects=["sub-2"]).select("sub").distinct().collect()} == {"sub-2", ""}


def test_scan_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "README").write_text("only this")
    assert [r.path for r in bids.scan(spark, str(tmp_path)).collect()] == ["README"]


def test_inspect(spark, folder, tmp_path):
    found = {(r.code, r.location) for r in registry.inspect(spark, folder).collect()}
    assert ("description", "BIDSVersion") in found and not [c for c, _ in found if c == "unlisted_subject"]
    (tmp_path / "m.csv").write_text("sub,path\nsub-1,stray.bin\nsub-1,gone.bin\n")
    assert {(r.code, r.location) for r in registry.inspect(spark, str(tmp_path / "m.csv")).collect()} == {("not_found", "gone.bin")}


def nifti(values, code, order="<"):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into(order + "h", head, 70, code)
    struct.pack_into(order + "8f", head, 76, 1, 2, 2, 3, 1, 1, 1, 1)
    struct.pack_into(order + "3f", head, 108, 352, 0.5, 10)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(values.dtype.newbyteorder(order)).tobytes(order="F")


def test_decoders_and_failures(spark, tmp_path):
    cube = np.arange(24, dtype="i2").reshape(2, 3, 4)
    signal = np.arange(10.0).reshape(5, 2)
    np.savez(tmp_path / "a.npz", **{"rec/x": signal, "rec/fs": np.array(250), "other/fs": np.array(1), "names": np.array(["A", "B"])})
    contents = {
        "v.nii.gz": gzip.compress(nifti(cube, 4)),
        "big.nii": nifti(cube, 4, ">"),
        "d.bvec": b"1 0\n0 1\n0 0\n",
        "d.bval": b"0 1000\n",
        "a.npz": (tmp_path / "a.npz").read_bytes(),
        "p.tsv.gz": gzip.compress(b"1\tn/a\n3\t4\n"),
        "h.tsv.gz": gzip.compress(b"a\tb\n3\t4\n"),
        "i.png": b"pixels",
        "bad.nii": b"no",
        "u.xyz": b"?",
        "e.bval": b"",
        "none.wav": None,
        "own.mine": b"abc",
    }
    registry.register_format(".mine", lambda data: {"kind": "mine", "attributes": {"n": str(len(data))}})
    df = spark.createDataFrame([(p, d, 1) for p, d in contents.items()], "path string, content binary, kind int")
    rows = {r.path: r for r in decode.decoded(df).collect()}
    assert len(rows) == len(contents)
    for name in ("v.nii.gz", "big.nii"):
        assert rows[name].shape == [2, 3, 4] and rows[name]["values"] == cube.ravel().tolist() and rows[name].attributes["scl_slope"] == "0.5"
    assert rows["d.bvec"].shape == [3, 2] and rows["d.bval"]["values"] == [0, 1000]
    assert (rows["a.npz"].shape, rows["a.npz"].sfreq, rows["a.npz"].labels) == ([2, 5], 250.0, ["A", "B"])
    assert rows["a.npz"]["values"] == signal.T.ravel().tolist()
    assert np.isnan(rows["p.tsv.gz"]["values"][1]) and rows["h.tsv.gz"].labels == ["a", "b"]
    assert bytes(rows["i.png"].content) == b"pixels" and rows["u.xyz"].kind == "reference" and rows["u.xyz"].content is None
    assert {p for p, r in rows.items() if r.error} == {"bad.nii", "e.bval", "none.wav"} and rows["own.mine"].attributes == {"n": "3"}
    assert bytes(decode.decoded(df, "embed").where(F.col("path") == "u.xyz").first().content) == b"?"
    assert decode.decoded(df.limit(0)).count() == 0


def test_command_line_from_a_folder_to_a_clone(spark, folder, tmp_path_factory, capsys, monkeypatch):
    from siltstone import cli

    tmp_path = tmp_path_factory.mktemp("out")

    monkeypatch.setenv("HOME", str(tmp_path))
    store = str(tmp_path / "store")

    def main(*args, code=0, at=store):
        assert cli.main([at, "--user", "u", *args]) == code, capsys.readouterr()
        return capsys.readouterr().out.splitlines()

    main("init")
    main("init", code=1)
    main("add", folder)
    assert "staged: sub-1" in main("status") and main("ls") == []
    main("commit", "-m", "first")
    assert main("commit", "-m", "none") == ["nothing is staged"]
    assert main("find", "--datatype", "eeg", "--sub", "sub-2") == ["sub-2/ses-a/eeg/sub-2_ses-a_task-rest_eeg"]
    assert main("query", "kind == 'recording'", "--count") == ["3"]
    assert main("verify", folder) == []
    main("mv", "sub-2/ses-a", "sub-2/ses-b")
    assert main("status") == ["on main", "staged: sub-2"]
    assert len(main("diff")) == 6
    main("switch", "main", code=1)
    main("reset")
    assert main("diff", "--exit-code") == []
    main("rm", "sub-2")
    main("commit", "-m", "second")
    assert main("query", "sub == 'sub-2'", "--count") == ["0"]
    main("verify", folder, code=1)
    main("branch", "side", "main~1")
    assert main("branch") == ["* main", "  side"]
    main("switch", "side")
    assert main("status") == ["on side"] and json.loads("".join(main("show")))["message"] == "first"
    main("switch", "main")
    main("remote", "add", "origin", store)
    assert main("remote", "list") == [f"origin\t{store}"] and main("log", "-n", "1", at="origin")[0].endswith("second")
    assert main("fsck") == [] and main("clone", str(tmp_path / "copy"), "--version", "side") == []
    assert main("query", "sub == 'sub-2'", "--count", at=str(tmp_path / "copy")) == ["4"]
    main("export", str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub=sub-1").is_dir()
    main("ls", at=str(tmp_path / "nowhere" / ".."), code=0)
    main("validate", folder, code=1)
    (pin,) = (tmp_path / "store" / "data").iterdir()
    pin.rename(tmp_path / "lost")
    assert any(line.startswith("error: no_snapshot") or "not_indexed" in line for line in main("fsck", code=1))


def test_explicit_items_and_derivatives(spark, tmp_path):
    from siltstone.operators.store import Repository, StoreError

    repo = Repository(spark, str(tmp_path / "store"))
    repo.create_subject("sub-1", age=30)
    repo.add_items("sub-1", [{"path": "eeg/a", "kind": "recording", "sfreq": 250.0}, {"path": "eeg/b", "kind": "table"}])
    head = repo.commit("made")
    with pytest.raises(StoreError):
        repo.create_subject("../x")
    with pytest.raises(StoreError):
        repo.create_subject("sub-1")
    repo.add_derivative("clean", repo.read().where("kind = 'recording'"), "1.0")
    repo.commit("cleaned")
    rows = {r.path: r for r in repo.read().collect()}
    assert set(rows) == {"sub-1", "sub-1/eeg/a", "sub-1/eeg/b", "sub-1/derivatives/clean/eeg/a"} and rows["sub-1"].age == 30
    made = rows["sub-1/derivatives/clean/eeg/a"]
    assert made.generated_by.asDict() == {"pipeline": "clean", "pipeline_version": "1.0", "source_version": head, "source_path": "sub-1/eeg/a"}
    with pytest.raises(StoreError):
        repo.migrate(repo.read())


def test_probe_plan_tree_and_stream(spark):
    from siltstone.operators import catalog, signal

    chunks = spark.createDataFrame([("a", [1.0] * 500), ("b", [float(k * 7919 % 1009) for k in range(500)]), ("c", None)], "k string, samples array<double>")
    sizes = signal.codec_sizes(chunks, ["k"])
    assert sizes.count() == 9 and {r.codec for r in sizes.collect()} == {"zstd(1)", "zstd(9)", "zlib(6)"}
    items = spark.createDataFrame([("x", "p"), ("x", "q"), ("z", "p")], "k string, j string")
    known = spark.createDataFrame([("x", "p", "A", 5), ("x", "p", "B", 4), ("x", "r", "A", 1)], "k string, j string, codec string, size long")
    plan = {(r.k, r.j): (r.codec, r.decided_by) for r in signal.codec_plan(items, known, ["k", "j"], "none").collect()}
    assert plan == {("x", "p"): ("B", 2), ("x", "q"): ("B", 1), ("z", "p"): ("none", 0)}
    for bad in ((("lz", 1),), (("zlib", 10),)):
        with pytest.raises(ValueError):
            signal.check_codecs(bad)
    for shape, chunk in (((5,), (1, 1)), ((5,), (0,)), ((1 << 40,), (1 << 40,))):
        with pytest.raises(ValueError):
            signal.check_layout(shape, chunk, 4)
    paths = spark.createDataFrame([("a/b/c",), ("a/b",), ("a/d",), ("e",)], "path string")
    assert {(r.name, r.is_item, r.n_items) for r in catalog.children(paths, "a").collect()} == {("b", True, 2), ("d", True, 1)}
    assert {r.name for r in catalog.children(paths, "").collect()} == {"a", "e"}
    told = []
    assert [r.path for r in catalog.streamed(paths, told.append)] == ["a/b/c", "a/b", "a/d", "e"] and told == [1, 2, 3, 4]


def test_remotes_and_storages(tmp_path, monkeypatch):
    from siltstone.sources import remotes

    known = remotes.Remotes(str(tmp_path / "r.json"))
    known.add("lab", "s3://bucket/x")
    assert known.resolve("lab/y") == "s3a://bucket/x/y" and known.resolve("gs://b") == "gs://b"
    for bad in (("lab", "/x"), ("a b", "/x"), ("k", "s3://u:p@b")):
        with pytest.raises(ValueError):
            known.add(*bad)
    known.remove("lab")
    with pytest.raises(remotes.UnknownRemote):
        known.remove("lab")
    (tmp_path / "s" / "refs").mkdir(parents=True)
    (tmp_path / "s" / "log").mkdir()
    (tmp_path / "s" / "a" / "b").mkdir(parents=True)
    assert remotes.discover(str(tmp_path / "s" / "a" / "b")) == str(tmp_path / "s") and remotes.discover("/") is None
    registry.register_storage("mine", lambda rest: f"hdfs://cluster/{rest}")
    assert registry.storage_uri("mine://a/", "b") == "hdfs://cluster/a/b"
    with pytest.raises(ValueError):
        registry.register_storage("s3", str)
