"""The predicate language against a plain evaluator over random subjects, and its refusals."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalog
from siltstone.plans import predicate

MISSING = object()


def numeric(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def shown(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def evaluated(node, row, kinds):
    match node:
        case None:
            return True
        case predicate.Both(parts=parts):
            return all(evaluated(p, row, kinds) for p in parts)
        case predicate.Either(parts=parts):
            return any(evaluated(p, row, kinds) for p in parts)
        case predicate.Complement(part=part):
            return not evaluated(part, row, kinds)
        case predicate.Exists(column=c):
            return row.get(c, MISSING) is not MISSING
    value = row.get(node.column, MISSING)
    if value is MISSING:
        return False
    numbers = [predicate.number_of(v) for v in node.values]
    if kinds.get(node.column) == "num" and all(n is not None for n in numbers):
        left, rights = float(value), numbers
    else:
        left, rights = shown(value), [predicate.text_of(v) for v in node.values]
    return {
        "==": lambda: left == rights[0], "!=": lambda: left != rights[0], "<": lambda: left < rights[0], "<=": lambda: left <= rights[0],
        ">": lambda: left > rights[0], ">=": lambda: left >= rights[0], "in": lambda: left in rights, "notin": lambda: left not in rights,
    }[node.op]()


EXPRESSIONS = [
    "sfreq >= 250", "sfreq == '500' or task == 'rest'", "not sfreq > 200", "task in ['rest', 'walk'] and not exists(sfreq)", "100 < sfreq <= 500",
    "task != 'rest'", "x > 2", "x == '7'", "x in [3, '4']", "x not in (3, 4)", "not x == 3", "sfreq in [250, 'abc']", "x >= 'a'", "exists(x) and task >= 'r'", "nothing == 1 or not nothing == 1",
]


def test_against_a_plain_evaluator(spark):
    rng = random.Random(3)
    rows, kinds = [], {}
    for s in range(12):
        texts = s % 3 == 0  # x is text in these subjects
        for k in range(rng.randint(0, 15)):
            row = {"sub": f"s{s}", "path": f"s{s}/{k}", "kind": "recording", "ses": "a", "task": rng.choice(["rest", "walk", "run", "Rest"])}
            if rng.random() < 0.8:
                row["sfreq"] = float(rng.choice([128, 250, 256, 500, 1000]))
            if rng.random() < 0.7:
                row["x"] = rng.choice(["3", "12", "n/a", "7"]) if texts else rng.choice([1, 3, 4, 7, 12])
            rows.append(row)
        kinds[f"s{s}"] = {"sfreq": "num", "x": "cat" if texts else "num"}
    flat = [(r["sub"], r["path"], "recording", "a", r["task"], r.get("sfreq"), None if numeric(r.get("x", "")) is False else float(r["x"]), r.get("x") if isinstance(r.get("x"), str) else None) for r in rows]
    df = spark.createDataFrame(flat, "sub string, path string, kind string, ses string, task string, sfreq double, num double, txt string")
    df = df.withColumn("dyn", F.create_map(F.lit("x"), F.struct("num", "txt"))).drop("num", "txt").cache()
    summary = catalog.summarize(df.drop("dyn"))
    for text in EXPRESSIONS:
        node = predicate.parse(text)
        want = {r["path"] for r in rows if evaluated(node, r, kinds[r["sub"]])}
        got = {r.path for r in predicate.where(df, text).select("path").collect()}
        assert got == want, text
        kept = {r["sub"] for r in catalog.prune(summary, node).select("sub").collect()}
        assert {p.split("/")[0] for p in want} <= kept, text


@pytest.mark.parametrize("text", ["a", "a ==", "a == b", "a == None", "f(a)", "a in 'abc'", "a in 3", "3 in a", "a + 1 == 2", "exists(1)", "[1] == a", "a is 3", "a == [1]", "lambda: 1", "a == [[1]]"])
def test_refusals(text):
    with pytest.raises(predicate.PredicateError):
        predicate.parse(text)


def test_forms():
    assert predicate.parse("250 <= sfreq") == predicate.Compare("sfreq", ">=", (250,))
    assert predicate.parse("col('odd name') == -1") == predicate.Compare("odd name", "==", (-1,))
    assert predicate.parse(meta__x__lt=4, task=["a", "b"]) == predicate.Both((predicate.Compare("meta.x", "<", (4,)), predicate.Compare("task", "in", ("a", "b"))))
    assert predicate.parse("") is None and predicate.columns_of(predicate.parse("a == 1 and not b.c > 2")) == {"a", "b.c"}
    assert predicate.paths_of(predicate.parse("path == 's/1' and x > 2")) == {"s/1"}


def test_number_text(spark):
    values = [7.0, 0.5, -3.0, 1e-7, 12345678.25, 0.001, 250.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(predicate.number_text(F.col("x"))).collect()] == ["7", "0.5", "-3", "1e-07", "12345678.25", "0.001", "250"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 3.0)], "path string, x double")
    assert [r.path for r in predicate.where(df, "x > 1").collect()] == ["b"]
    assert [r.path for r in predicate.where(df, "not exists(x)").collect()] == ["a"]
    assert predicate.where(df, "x == 'nan'").count() == 0 and predicate.where(df, "x != 'nan'").count() == 1
