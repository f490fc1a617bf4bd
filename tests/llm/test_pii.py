import re

import pytest

from levylens.llm import pii
from levylens.llm.queries import op3_pii
from tests.llm import brute

KEY = "a key"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    return pii.pseudonymised(df, KEY, **options).collect()


def one(spark, text):
    return run(spark, [(1, text)])[0].text


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("card", ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "378282246310005",
                  "3782 822463 10005", "4041894974608796"]),
        ("ipv4", ["42.144.35.254", "0.0.0.0", "300.1.1.1"]),
        ("phone", ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+49 30 1234567", "+33 1 23 45 67 89", "+15551234567",
                   "+442079460958", "+7 495 123-45-67", "+353 1 234 5678"]),
        ("mail", ["bosbt.42@mail8.example.com", "A_b+c%d-e@x.org", "x@y.de"]),
    ],
)
def test_same_as_python(spark, kind, values):
    for value in values:
        expected = getattr(brute, kind)(KEY, value)
        assert one(spark, f"at {value}, and ({value})") == f"at {expected}, and ({expected})"


def test_dates(spark):
    rows = [(i, t) for i, t in enumerate(["1984-02-29", "31.12.1999", "05/06/2020", "12/25/2020", "0001-01-01", "9999-12-31"])]
    new = [r.text for r in run(spark, rows)]
    assert all(a != b for (_, a), b in zip(rows, new, strict=True))
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for (_, a), b in zip(rows, new, strict=True))
    assert new[0][:2] == "19" and new[1][6:8] == "19" and new[2][6:8] == "20"
    same = ["1983-02-29", "00.01.2000", "31/31/2000", "0000-01-01", "1-2-2000"]
    assert [r.text for r in run(spark, list(enumerate(same)))] == same


def test_a_century_is_permuted(spark):
    days = spark.sql("select explode(sequence(date'1900-01-01', date'1999-12-31')) as day")
    df = days.selectExpr("cast(day as string) as text")
    out = pii.pseudonymised(df, KEY)
    assert out.distinct().count() == df.count() == out.intersect(df).count()


def test_small_numbers_are_permuted(spark):
    df = spark.range(10_000).selectExpr("format_string('42.7.%d.%d', id div 256, id % 256) as text")
    assert pii.pseudonymised(df, KEY).distinct().count() == 10_000


def test_what_is_not_personal_stays(spark):
    texts = ["000-12-3456", "666-12-3456", "v1.2.3.4.5", "12345678901234567890", "a1234567890123456b", "1,234.56",
             "2021-13-01", "x@y", "@home", "+123", ""]
    assert [r.text for r in run(spark, list(enumerate(texts)))] == texts


def test_edges(spark):
    long = "é" * 200_000 + " 4041894974608795 " + "a-" * 200_000 + "7" * 50_000
    rows = [(1, None), (2, ""), (None, "42.144.35.254"), (3, long), (3, long)]
    got = run(spark, rows, findings_col="findings")
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 5 and by_id[1].text is None and by_id[2].text == "" and by_id[1].findings == []
    card = brute.card(KEY, "4041894974608795")
    assert by_id[3].text == long.replace("4041894974608795", card) and by_id[3].found == "x"
    assert [tuple(x) for x in by_id[None].findings] == [("ipv4", "42.144.35.254", brute.ipv4(KEY, "42.144.35.254"))]
    assert run(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_pii(spark, folder).collect()}
    kinds = {"card": r"\b[0-9]{16}\b", "ipv4": r"\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b", "mail": r"[\w.]+@[\w.]+\w",
             "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}
    found = 0
    for doc_id, text, *_ in spark.read.parquet(f"{folder}/documents.parquet").collect():
        expected = text
        for kind, pattern in kinds.items():
            old = re.findall(pattern, text, re.A)
            if kind == "card":
                old = [x for x in old if brute.check_digit(x[:-1]) == x[-1]]
            found += len(old)
            assert rows[doc_id][f"n_{kind}"] == len(old)
            new = getattr(brute, kind)
            expected = re.sub(pattern, lambda m: new("levylens corpus", m[0]), expected, flags=re.A)
        assert rows[doc_id].text == expected
    assert found > 30


def test_social_security_numbers_stay_valid(spark):
    """Sampled and extreme numbers stay valid, stay different, and a second run knows them again."""
    import random

    rng = random.Random(1)
    areas = [*range(1, 666), *range(667, 900)]
    old = {f"{rng.choice(areas):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(3000)}
    old |= {"001-01-0001", "899-99-9999", "665-01-0001", "667-99-9999"}
    df = spark.createDataFrame([(x,) for x in sorted(old)], "text string")
    new = [r.text for r in pii.pseudonymised(df, KEY, findings_col="f").collect()]
    assert len(set(new)) == len(old) and sum(a == b for a, b in zip(sorted(old), new)) < 3
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in new)
    again = pii.pseudonymised(spark.createDataFrame([(x,) for x in new], "text string"), KEY, findings_col="f")
    assert again.selectExpr("min(size(f))").first()[0] == 1


def test_a_number_is_linked_across_spellings(spark):
    texts = ["+15551234567", "+1 555-123-4567", "+1 (555) 123-4567", "+1.555.123.4567"]
    new = {re.sub("[^0-9+]", "", r.text) for r in run(spark, list(enumerate(texts)))}
    assert len(new) == 1 and new.pop().startswith("+1") and "+15551234567" not in new


def test_a_date_before_an_at_sign_is_a_mail_address(spark):
    got = run(spark, [(1, "to 2020-01-01@corp.com or 4041894974608795@x.org, born 2020-01-01")], findings_col="f")[0]
    assert [x.kind for x in got.f] == ["mail", "mail", "date"]
    assert got.text.split()[1].endswith("@corp.com")
