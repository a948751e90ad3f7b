import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import pii, queries

KNOWN = [
    r"[^\W_][\w.%+-]*@[\w.-]+\.[a-zA-Z]{2,}",
    r"\+1 \(\d{3}\) \d{3}-\d{4}",
    r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)",
    r"(?<!\w)\d{16}(?!\w)",
    r"(?<!\w)[0-9a-fA-F]{40}(?!\w)",
]


def test_whole_table(spark):
    """All that stands between the entities known to be in these texts is as it was; the entities aren't."""
    sf_dir = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    new = {r.doc_id: r for r in queries.op5_pii(spark, sf_dir).collect()}
    assert old.keys() == new.keys()
    any_known = re.compile("|".join(KNOWN))
    stands_for = {}
    for k, text in old.items():
        was, now = any_known.findall(text), any_known.findall(new[k].text)
        assert len(was) == len(now) <= new[k].n_entities
        if not was:
            assert new[k].n_entities > 0 or new[k].text == text
            continue
        assert any_known.split(text) == any_known.split(new[k].text)
        for a, b in zip(was, now, strict=True):
            assert a.lower() != b.lower() and ("@" in a or len(a) == len(b) or a.count(".") == 3)
            assert stands_for.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(stands_for) > 50 and len(set(stands_for.values())) == len(stands_for)
    assert not set(stands_for) & set(stands_for.values())


def one(spark, text):
    return pii.pseudonymized(spark.createDataFrame([(text,)], "text string"), "k").first().text


def test_kinds_keep_gender_script_and_format(spark):
    texts = [
        "Mr. John Smith met Mary Jones.",
        "г-жа Анна Иванова, +49 30 1234567; 123-45-6789",
        "DE89 3704 0044 0532 0130 00 on 10.0.0.1, 4516-7448-5457-4821",
        'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! a version 2.0.1 of 2024-01-02, 50 % of 1,000,000',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b, c, d = (r.text for r in pii.pseudonymized(df, "k").collect())
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+)\.", a)
    assert m[1] in pii.NAMES["m", "latin"] and m[3] in pii.NAMES["f", "latin"] and m[2] != "Smith" and m[4] != "Jones"
    m = re.fullmatch(r"г-жа (\w+) ([а-яА-Я]+), (\+4\d \d\d \d{7}); (\d{3}-\d\d-\d{4})", b)
    assert m[1] in pii.NAMES["f", "cyrillic"] and m[3] != "+49 30 1234567" and m[4] != "123-45-6789"
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d on (\d+\.){3}\d+, 4\d{3}-\d{4}-\d{4}-\d{4}", c) and "10.0.0.1" not in c
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"!! a version 2\.0\.1 of 2024-01-02, 50 % of 1,000,000', d) and "9233A8" not in d


def test_digits_are_permuted_without_collision(spark):
    df = spark.range(10_000).select(F.array(F.struct(F.format_string("%04d", "id").alias("raw"), F.lit("ssn").alias("kind"), F.format_string("%04d", "id").alias("norm"), F.lit(0).alias("attempt"))).alias("e"))
    assert df.select(F.get(pii.surrogates(F.col("e"), "k"), F.lit(0)).alias("s")).distinct().count() == 10_000


def test_collisions_get_another_try(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("ba", "do"))
    distinct = spark.createDataFrame([("surname", f"Name{k}", f"Name{k}") for k in range(30)], "kind string, norm string, raw string")
    again = pii.retries(distinct, "k")
    rows = {r.norm: r.attempt for r in again.collect()}
    final = distinct.join(again, ["kind", "norm"], "left").fillna(0, ["attempt"])
    made = final.select(F.get(pii.surrogates(F.array(F.struct("raw", "kind", "norm", "attempt")), "k"), F.lit(0)).alias("s")).collect()
    assert rows and len({r.s for r in made}) == 30
    texts = spark.createDataFrame([(f"saw Mary Name-{c} and Mary Name-{c}!",) for c in ("Ab", "Bc", "Cd", "De", "Ef", "Fg", "Gh", "Hi", "Ij", "Jk", "Kl", "Lm", "Mn", "No", "Op", "Pq", "Qr", "Rs")], "text string")
    got = [re.fullmatch(r"saw (\w+ \w+) and (\w+ \w+)!", r.text) for r in pii.pseudonymized(texts, "k").collect()]
    assert all(m[1] == m[2] for m in got) and len({m[1] for m in got}) == 18


def test_names_cannot_run_out(spark):
    texts = [f"κύριος {n} ήρθε" for n in pii.NAMES["m", "greek"]] + [f"{n} Smith and" for n in pii.NAMES["m", "latin"]]
    got = [r.text for r in pii.pseudonymized(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.fullmatch(r"κύριος [α-ωΑ-Ω]+ ήρθε|[A-Za-z]+ [A-Z][a-z]+ and", t) for t in got)


def test_all_digits_in_use_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2)
    distinct = spark.createDataFrame([("ssn", str(d), str(d)) for d in range(10)], "kind string, norm string, raw string")
    with pytest.raises(RuntimeError):
        pii.retries(distinct, "k")


def test_short_forms_name_the_same_person(spark):
    texts = ["Mary Smith met", "Mrs Smith met", "Dr Mary Smith met", "Mr. John Smith met", "My name is Emily Carter, yes"]
    a, b, c, d, e = (r.text for r in pii.pseudonymized(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect())
    given, family = a.split()[:2]
    assert family != "Smith" and (b, c) == (f"Mrs {family} met", f"Dr {given} {family} met")
    assert d.split()[2] == family and d.split()[1] not in ("John", given)
    assert e.startswith("My name is ") and e.endswith(", yes") and "Emily" not in e and "Carter" not in e


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_check_digits_and_calling_codes_fit(spark):
    texts = ["4532 0151 1283 0366", "4532015112830367", "DE89 3704 0044 0532 0130 00", "+351 912 345 678", "call 555 123 4567", "06 12 34 56 78", "see fe80::1ff:fe23:4567:890a", "de" + "adbeef" * 6]
    got = [r.text for r in pii.pseudonymized(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()]
    assert all(a != b and len(a) == len(b) for a, b in zip(texts, got, strict=True))
    assert luhn(got[0]) and re.fullmatch(r"4\d{3}( \d{4}){3}", got[0]) and re.fullmatch(r"4\d{15}", got[1])
    compact = got[2].replace(" ", "")
    assert compact[:2] == "DE" and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    assert re.fullmatch(r"\+351 \d{3} \d{3} \d{3}", got[3]) and re.fullmatch(r"call \d{3} \d{3} \d{4}", got[4]) and re.fullmatch(r"(\d\d ){4}\d\d", got[5])
    assert re.fullmatch(r"see [0-9a-f]{4}::[0-9a-f]{3}(:[0-9a-f]{4}){3}", got[6]) and re.fullmatch(r"[0-9a-f]{38}", got[7])


def test_spellings_of_an_entity_share_a_surrogate(spark):
    texts = ["(555) 123-4567", "555-123-4567", "token=ABCDEF0123456789", "password: abcdef0123456789"]
    a, b, c, d = (r.text for r in pii.pseudonymized(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect())
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "5551234567"
    assert c.partition("=")[2].lower() == d.partition(": ")[2] != "abcdef0123456789"


def test_odd_rows(spark):
    long = "word " * 40_000 + "a@b.com"
    rows = [(1, None, 5), (2, "", 5), (None, "a@b.com", 5), (3, long, 5), (3, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int")
    got = sorted(((r.doc_id or 0, r.n_entities, r._n_entities) for r in pii.pseudonymized(df, "k").collect()))
    assert got == [(0, 1, 5), (1, 0, 5), (2, 0, 5), (3, 1, 5), (3, 1, 5)]
    assert pii.pseudonymized(df.limit(0), "k").count() == 0
