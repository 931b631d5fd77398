"""URL rules against plain string conditions."""

import random

from gleaner.llm import urls


def plain_place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain_verdict(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


ODD = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y=/z#w", "http://example.com/en", "http://a.b.net/es/://net/fr/", "http://xcom/en/", "http://example.com:80/en/", "http://.net/fr/", "http://..com//", "x?a://net/es/", "http://É.COM/en/#a?b", "http://n\net/es/", "http://" + "a." * 500 + "net/fr" + "/x" * 500, "http://net#/es/"]


def compare(spark, pages, rules):
    df = spark.createDataFrame([(i, u, "mine", 1) for i, u in pages], "page_id long, url string, rule string, best int")
    got = urls.judge(df, urls.rule_table(spark, rules)).collect()
    assert len(got) == len(pages)
    want = []
    for i, u in pages:
        host, path = plain_place(u)
        want.append((i, host, path, *plain_verdict(host, path, rules)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_urls(spark):
    compare(spark, [*enumerate(ODD), (None, ODD[7]), (3, ODD[9]), (3, ODD[9])], urls.RULES)


def test_many_rules(spark):
    # rules that end between slashes, share hosts, hide one another or have no path
    rnd = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r/s/", "/pq"]
    rules = [(h, p, rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.5]
    pages = [(i, f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'z', '/z'])}") for i in range(300)]
    compare(spark, pages, rules)


def test_no_rules_and_no_pages(spark):
    none = urls.rule_table(spark).where("false")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert urls.judge(pages.where("false"), urls.rule_table(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = urls.judge(pages.limit(1), urls.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
