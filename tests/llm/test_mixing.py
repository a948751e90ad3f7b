import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, queries


def brute(cells, targets, rounds=200):
    """Raking by hand: cells {(a, b): n}, targets [{a: share}, {b: share}]."""
    cells = {k: float(n) for k, n in cells.items() if all(k[d] in t for d, t in enumerate(targets))}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            present = {k[d] for k in cells}
            whole = sum(s for v, s in target.items() if v in present)
            sums = {}
            for k, w in cells.items():
                sums[k[d]] = sums.get(k[d], 0.0) + w
            cells = {k: w * target[k[d]] / whole / sums[k[d]] for k, w in cells.items()}
    return cells


@pytest.mark.parametrize("carried", [20_000, 2])
def test_raking_by_brute_force(spark, monkeypatch, carried):
    monkeypatch.setattr(mixing, "CARRIED_CELLS", carried)  # in one task, and in exchanges
    cells = {("x", "1"): 100, ("x", "2"): 10, ("y", "1"): 5, ("y", "2"): 50, ("z", "1"): 7, ("w", "2"): 3}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "a string, b string, n long")
    targets = [{"x": 0.5, "y": 0.3, "z": 0.1, "none": 0.1}, {"1": 0.6, "2": 0.4}]
    tables = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in zip("ab", targets, strict=True)}
    got = {(r.a, r.b): r.w for r in mixing.rake(df, tables, tolerance=1e-9).collect()}
    want = brute(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_whole_table_meets_its_targets(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op9_mixing(spark, sf_dir).withColumn("expected", F.col("tokens") * F.col("probability"))
    rows = got.toPandas()
    assert len(rows) == docs.count() and rows.probability.between(0, 1).all() and rows.probability.max() > 0.999
    for dim in ("source", "lang"):
        share = rows.groupby(dim).tokens.sum() ** queries.FLATTENING[dim]
        share /= share.sum()
        reached = rows.groupby(dim).expected.sum() / rows.expected.sum()
        assert (share - reached).abs().max() < 1e-3
    drawn = (rows.tokens * rows.keep).sum()
    assert abs(drawn / rows.expected.sum() - 1) < 0.25


def test_odd_rows(spark):
    rows = [(1, None, "a", "en", 9), (2, "", None, "en", 9), (3, "x y z", "a", None, 9), (3, "x y z", "a", None, 9), (None, "q " * 40_000, "b", "fr", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep int")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    got = mixing.mixed(df, dims, mixing.token_count(F.col("text")), {"source": 0.5, "lang": 0.5}).collect()
    assert sorted((r.doc_id or 0, r.tokens, r._keep) for r in got) == [(0, 40_000, 9), (1, 0, 9), (2, 0, 9), (3, 3, 9), (3, 3, 9)]
    assert all(r.probability == 0 and not r.keep for r in got if r.tokens == 0)
    assert mixing.mixed(df.limit(0), dims, mixing.token_count(F.col("text")), {"source": 0.5, "lang": 0.5}).count() == 0


def test_a_scarce_cell_does_not_thin_the_rest(spark):
    rows = [(k, "w " * 50, f"s{k % 3}", "en" if k % 5 else "de") for k in range(600)] + [(600, "five words of one source", "rare", "en"), (601, "w " * 40, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    got = mixing.mixed(df, dims, mixing.token_count(F.col("text")), {"source": 0.5, "lang": 0.7}).toPandas()
    got["expected"] = got.tokens * got.probability
    assert got.probability.between(0, 1).all() and got.probability.max() == 1
    assert abs(got.expected.sum() / got.tokens.sum() - mixing.LEAST_KEPT) < 1e-3
    assert (got[got.doc_id >= 600].probability > 0.999).all()
    # The rest has the shares of the targets among themselves.
    rest = got[got.doc_id < 600]
    lang = rest.groupby("lang").tokens.sum() ** 0.7
    reached = rest.groupby("lang").expected.sum()
    assert abs(reached["de"] / reached["en"] - lang["de"] / lang["en"]) < 0.02
    source = rest.groupby("source").expected.sum()
    assert source.max() / source.min() < 1.01


def test_raking_within_a_size_by_brute_force(spark):
    cells = {("x", "1"): 1000, ("x", "2"): 100, ("y", "1"): 500, ("y", "2"): 600}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "a string, b string, n long")
    tables = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in {"a": {"x": 0.5, "y": 0.5}, "b": {"1": 0.5, "2": 0.5}}.items()}
    got = {(r.a, r.b): r.w for r in mixing.rake(df, tables, tolerance=1e-5, size=1000.0).collect()}
    # All hundred tokens of (x, 2) are taken; the margins fix the others.
    want = {("x", "1"): 0.4, ("x", "2"): 0.1, ("y", "1"): 0.1, ("y", "2"): 0.4}
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_tokens_and_topics_by_brute_force(spark):
    texts = [" a  b\n\nc\t d ", "", "   ", "\r\n", "x", "a\u00a0b c", "a\x0bb\x0cc\rd", "#$%&*! " * 40, "| a | b |", "w " * 300, "é" * 501, "!" * 30 + "w" * 500, "\u2003 a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, text string")
    got = {r.k: (r.n, r.topic) for r in df.select("k", mixing.token_count(F.col("text")).alias("n"), mixing.topic_of(F.col("text")).alias("topic")).collect()}

    def topic(t):
        size = max(1, len(t))
        if t.count("|") / size > 0.02:
            return "tabular"
        if sum(map(t.count, "#$%&*!")) / size > 0.05:
            return "noisy"
        return "short" if len(t) < 500 else "prose"

    assert got == {k: (len(t.encode().split()), topic(t)) for k, t in enumerate(texts)} | {99: (0, "short")}


def test_margins_that_cannot_be_met_are_reported(spark):
    cells = spark.createDataFrame([("x", "1", 10), ("y", "2", 10)], "a string, b string, n long")
    tables = {"a": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "value string, share double"), "b": spark.createDataFrame([("1", 0.1), ("2", 0.9)], "value string, share double")}
    assert mixing.rake(cells, tables, iterations=3).first()["off"] > 0.5
