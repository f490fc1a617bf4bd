import random
import re

from levylens.llm import urlfilter


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def brute(url, rules):
    host, path = parts(url)
    fit = [
        (len(h) + len(p), len(h), a, h + p) for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


def run(spark, pages, rules, **options):
    pages = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    return urlfilter.judged(pages, rules, **options).collect()


def test_same_as_all_pairs(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "xcom", "ä.com", "a.com", ""]
    paths = ["", "/", "/e", "/es/", "/es/a", "/es/a/b", "/en/1", "/en/12", "/é", "/\uffff", "/\U0010ffff"]
    rules = {(rng.choice(hosts[:8]), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(*k, v) for k, v in rules.items()]
    urls = [
        f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts).upper()}{rng.choice(paths)}"
        f"{rng.choice(['', 'x', '/z', '?q=://org/es/', '#/es/'])}"
        for _ in range(600)
    ]
    urls += [None, "", "no scheme", "://org/es/", "a://b://org/", "http://example.org:80/es/", "x://\n/es"]
    pages = list(enumerate(urls)) + [(None, urls[0]), (0, urls[0]), (0, urls[0])]
    for shares in (1, 7):
        got = run(spark, pages, rules, shares=shares)
        expected = [(i, u, *brute(u, rules)) for i, u in pages]
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_listed_twice_blocks_and_nulls_take_no_part(spark):
    rules = [("org", "/", "allow"), ("ORG", "/", "block"), (None, "/", "block"), ("com", None, "block"),
             ("com", "/", None)]
    got = run(spark, [(1, "http://a.org/"), (2, "http://a.com/")], rules)
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "org/", "block"), (2, None, "allow")}


def test_empty_tables(spark):
    assert run(spark, [], [("org", "/", "block")]) == []
    got = run(spark, [(1, "http://a.org/")], [], default="block")
    assert [(r.rule, r.verdict) for r in got] == [(None, "block")]
