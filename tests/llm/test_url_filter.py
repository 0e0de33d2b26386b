import random

from tessera.llm.url_filter import RULES, judge_urls, split_url


def plain(url):
    host, path = split_url(url)
    best = max(((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


def test_rules_equal_a_plain_search(spark):
    r = random.Random(6)
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "org", "b.com", "com", "net", "x.y.example.org", "", "example.org:80", "."]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a?b", "/de/#c", "?q=/es/", "/FR/", "#/es/"]
    urls = [r.choice(["http://", "https://", "", "x://y://"]) + r.choice(hosts) + r.choice(paths) for _ in range(600)] + [None, "", "://", "http:///es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    # a filter of one block lets nearly everything pass: the join must still be exact
    for blocks in (1, 1 << 10):
        for x in judge_urls(pages, rules, blocks=blocks).collect():
            assert (x.host, x.path, x.rule, x.verdict) == plain(urls[x.page_id]), urls[x.page_id]
    again = pages.union(pages)
    assert judge_urls(again, rules).count() == 2 * len(urls)


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judge_urls(pages, rules.where("1 = 0"), keep=("page_id", "host")).collect()[0].verdict == "allow"
    assert judge_urls(pages.where("1 = 0"), rules).count() == 0
    odd = judge_urls(pages, rules, keep=("page_id", "url"))
    assert odd.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and odd.first().url == "http://a.org/"
    wide = spark.createDataFrame([("É.Org", "/", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in judge_urls(spark.createDataFrame([(1, "http://É.org/")], "page_id long, url string"), wide).collect()] == ["block"]
