import hashlib

import pytest

import corpus_pipeline
from siltstone.llm import bpe, langid, neardup, queries

tiktoken = pytest.importorskip("tiktoken")


def test_stages_by_hand(spark, tmp_path):
    """Every stage on what the one before it kept, against a plain reading of its result."""
    sf_dir = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    languages, unique, private, mixed, tokens = kept
    assert set(languages) == {k for k, t in start.items() if langid.has_letter(t or "")}
    classes = neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/language_id")).collect()
    assert set(unique) == {r.doc_id for r in classes if r.keep} and len(unique) == len({r.class_id for r in classes})
    assert set(private) == set(unique) and all(r.n_chars == len(r.text) for r in private.values())
    assert not any("mail" in r.text and ".example.com" in r.text and start[k] == r.text and "@" in r.text for k, r in private.items())
    assert set(mixed) <= set(private) and mixed
    ranks, pattern = queries.tokenizer_file()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    assert tokens.keys() == mixed.keys()
    for k, r in tokens.items():
        assert r.ids == other.encode_ordinary(mixed[k].text)
        assert r.decoded_sha256 == hashlib.sha256(mixed[k].text.encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 0


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "the cat and the dog " * 9, "en", None, 1, "x"), (3, "der Hund " * 9, "de", "a", 1, "x"), (3, "der Hund " * 9, "de", "a", 1, "x"), (4, "12 34", "en", "b", 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string"
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(part)}-{n}"
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            if name == "near_dedup":
                assert docs.count() == (2 if part else 0)
