from pyspark.sql import functions as F

from focuslake.llm import queries, urls
from focuslake.llm.urls import Rule, filter_urls

RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "org", "/es/")]


def judge(spark, pages, listed, rules=RULES):
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"), rules).collect()
    return sorted(((r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in rows), key=repr)


def test_rules_and_list(spark):
    got = judge(spark, [
        (1, "HTTP://WWW.Example.COM/en/7?x"), (2, "https://a.com/en/1#z"), (3, "https://nocom/en/1"), (4, "x://b.net"), (5, None),
        (6, "no scheme"), (7, "http://q.net/a/b.html?c=1"), (7, "http://q.net/a/b.html?c=1"), (8, "http://xorg/es/"), (9, "http://y.org/es")],
        ["https://www.q.net/a/b/", None, "junk"])
    assert got == sorted([
        (1, "www.example.com", "/en/7", "example.com/en/7", False, "allow"), (2, "a.com", "/en/1", "com/en/", False, "block"),
        (3, "nocom", "/en/1", None, False, "allow"), (4, "b.net", "", None, False, "allow"), (5, "", "", None, False, "allow"),
        (6, "", "", None, False, "allow"), *[(7, "q.net", "/a/b.html", None, True, "block")] * 2, (8, "xorg", "/es/", None, False, "allow"),
        (9, "y.org", "/es", None, False, "allow")], key=repr)


def test_rules_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.text: r.verdict for r in queries.URL_RULES} == words
    pages = [(1, "http://a.net/de/1"), (2, "http://b.example.net/de/80"), (3, "http://a.net/en/1"), (4, "http://net/de/")]
    got = judge(spark, pages, ["http://a.net/de/1", "http://a.net/en/1"], queries.URL_RULES)
    assert [(r[3], r[5]) for r in sorted(got, key=lambda r: (r[1], r[2]))] == [
        ("net/de/", "allow"), (None, "block"), ("example.net/de/8", "block"), ("net/de/", "allow")]


def test_no_false_positive_and_no_miss(spark):
    known = {f"http://h{i % 50}.net/p/{i}" for i in range(0, 3000, 3)}
    got = judge(spark, [(i, f"http://h{i % 50}.net/p/{i}") for i in range(3000)], known, [])
    assert {r[0] for r in got if r[4]} == set(range(0, 3000, 3)) and len(got) == 3000


def test_filter_lets_few_others_pass(spark):
    listed = spark.range(2000).select(F.concat(F.lit("a.net/"), "id").alias("canonical"))
    blocks = urls.blocks_for(2000)
    assert blocks & (blocks - 1) == 0 and blocks * 512 >= 2000 * urls.BITS_PER_URL
    bloom = urls.bloom_filter(listed, blocks).cache()
    assert bloom.count() <= blocks
    bits = sum(bin(r[f"w{j}"] & (1 << 64) - 1).count("1") for r in bloom.collect() for j in range(8))
    assert bits < 0.55 * blocks * 512


def test_wide_filters_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    got = judge(spark, [(i, f"http://a.net/{i}") for i in range(100)], [f"http://a.net/{i}" for i in range(50)])
    assert sum(r[4] for r in got) == 50


def test_empty_tables_and_clashing_columns(spark):
    assert judge(spark, [], ["http://a.net/1"]) == []
    assert [r[4] for r in judge(spark, [(1, "http://a.net/1")], [])] == [False]
    df = spark.createDataFrame([(1, "http://a.net/1", "mine", "y", 5)], "page_id long, url string, host string, `odd name` string, block int")
    row = filter_urls(df, spark.createDataFrame([], "url string"), RULES).first()
    assert row["host"] == "a.net" and row["odd name"] == "y" and row["block"] == 5
    used = ["w0", "w7", "__key", "__block", "__possible", "__url", "__found", "in_0", "canonical", "Listed"]
    wide = df.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(used)])
    for listed in ([], [("http://a.net/1",)]):
        out = filter_urls(wide, spark.createDataFrame(listed, "url string"), RULES)
        assert [out.columns.count(c) for c in used] == [1] * (len(used) - 1) + [0]
        row = out.first()
        assert [row[c] for c in used[:-1]] == list(range(len(used) - 1)) and row["listed"] == bool(listed)
    plan = filter_urls(df, spark.createDataFrame([], "url string"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
