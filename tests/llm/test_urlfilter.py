import math

from pyspark.sql import functions as F

from cloneflow.llm import urlfilter


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:stop]


def brute_rule(host, path, rules):
    fit = [(len(of + start), len(of), of + start, verdict) for of, start, verdict in rules if (host == of or host.endswith("." + of)) and path.startswith(start)]
    return max(fit)[2:] if fit else (None, None)


URLS = [
    None, "", "no scheme/at all", "http://", "https://example.org", "http://EXAMPLE.org/es/1", "http://a.example.org/en/1?x=/fr/", "http://a.example.org/en/2",
    "http://notexample.org/es/x", "http://www.b.com/fr/", "http://www.b.com/de/x#y", "http://www.b.com/en/", "https://x.net?q=1", "x://ÄB.net#://", "http://com/de/",
    "http://b.com/de", "http://user@b.com/fr/\n", "http://h.example.net/a b",
]


def judged(spark, urls, labels, **options):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"html": F.lit("x"), "host": F.lit("mine"), "n": F.lit(1)})
    marks = spark.createDataFrame(labels, "page_id long, bad int")
    return {r.page_id: r for r in urlfilter.judge_urls(pages, marks, **options).collect()}


def test_parts_and_rules(spark):
    got = judged(spark, URLS, [])
    for i, url in enumerate(URLS):
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path, urlfilter.RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url
    assert judged(spark, [], []) == {}
    assert all(r.rule is None for r in judged(spark, URLS, [], rules=[]).values())


def test_reputation_shrinks_towards_the_domain(spark):
    urls, labels = [], []

    def host(name, good, bad, unknown=0):
        for n, mark in ((good, 0), (bad, 1), (unknown, None)):
            for _ in range(n):
                labels.append((len(urls), mark))
                urls.append(f"http://{name}/p{len(urls)}")

    host("spam.bad.net", 0, 60)
    host("more.bad.net", 2, 58)
    host("new.bad.net", 0, 0, 3)
    host("one.fine.net", 59, 1)
    host("two.fine.net", 0, 1, 2)
    host("far.other.info", 30, 0)
    labels += [(0, 1), (0, None), (None, 1), (10**6, 1)]
    got = judged(spark, urls, labels)
    of = {r.host: r for r in got.values()}
    assert of["spam.bad.net"].verdict == of["more.bad.net"].verdict == "block"
    assert of["two.fine.net"].verdict == of["one.fine.net"].verdict == of["far.other.info"].verdict == "allow"
    assert of["new.bad.net"].mean > 0.6 > of["two.fine.net"].mean
    assert all(0 <= r.low <= r.mean <= 1 for r in of.values())


def test_strength_of_a_known_beta_binomial(spark):
    """Groups drawn with alpha + beta = 8: the moment estimate comes close."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(40, int(rng.binomial(40, rng.beta(2, 6)))) for _ in range(4000)]
    found = urlfilter.prior_strength(spark.createDataFrame(rows, "n long, bad long")).first()[0]
    assert math.isclose(found, 8, rel_tol=0.15)
    alike = spark.createDataFrame([(1000, 100)] * 50, "n long, bad long")
    assert urlfilter.prior_strength(alike).first()[0] == urlfilter.MAX_STRENGTH
    assert urlfilter.prior_strength(alike.limit(0)).first()[0] == urlfilter.MIN_STRENGTH


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    made = urlfilter.judge_urls(pages, spark.createDataFrame([(1, 0)], "page_id long, bad int"))
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
