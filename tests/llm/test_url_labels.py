"""What URL rules learn from labels: whose labels they are, held-out results, chance, and odd tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.llm import url_filter

PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def test_document_and_tokens(spark):
    urls = ["http://a.B.example.org/en/7817?utm_source=feed&x=1#top", "http://h/12/34.html", "http://h/x12/y", "http://h", None, "http://h/en/123456789012345678901"]
    rows = url_filter._rows(spark.createDataFrame(list(enumerate(urls)), PAGES), (), "page_id", "url").orderBy("id").collect()
    assert [r.doc for r in rows] == [7817, 34, None, None, None, None]
    assert set(rows[0].tokens) == {"scheme:http", "tld:org", "fragment:1", "host:a", "host:b", "host:example", "host:org", "path:en", "path:7817", "key:utm_source", "key:x"}
    assert set(rows[1].tokens) >= {"ext:html", "path:12", "path:34.html"} and rows[4].tokens == []


def test_pages_hold_the_document_their_path_names(spark, sf):
    """The number in a page's path is the id of the document in it: the page has the document's first words."""
    pages = url_filter._rows(spark.read.parquet(f"{sf}/pages.parquet"), (), "page_id", "url").select("id", "doc").join(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS id", "html"), "id")
    both = pages.join(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS doc", "text"), "doc").collect()
    same = sum(" ".join(r.text.split()[:5]) in " ".join(r.html.split()) for r in both)
    assert len(both) > 20 and same >= 0.7 * len(both)


def planted(spark, n=6000, seed=3):
    """Documents under casino hosts, and of one path with one query key, are bad; so are some others by chance."""
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(n):
        host, path, key = rng.choice(["casino", "news", "blog", "shop"]), rng.choice(["a", "b", "c"]), rng.choice(["x", "y"])
        bad = host == "casino" or (path == "b" and key == "y")
        bad = bad if rng.random() < 0.98 else not bad
        pages.append((i, f"http://www.{host}.example.org/{path}/{i}?{key}=1"))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)


def test_held_out_precision_and_recall(spark):
    got = url_filter.held_out(*planted(spark)).first()
    assert got.right >= 0.9 * got.blocked and got.right >= 0.9 * got.bad and got.bad > 100


def test_rules_of_chance_go(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST", 5)
    pages = spark.createDataFrame([(i, f"http://s{i % 200}.example.org/{i}") for i in range(3000)], PAGES)
    rng = random.Random(1)
    labels = spark.createDataFrame([(i, 1, int(rng.random() < 0.25)) for i in range(3000)], LABELS)
    rows = url_filter.labelled(url_filter._rows(pages, url_filter.RULES, "page_id", "url"), labels)
    assert url_filter.mine(rows, 0.001, 0.5).count() == 0 and url_filter.mine(rows, 0.001, 0.5, chance=1e9).count() > 0


def test_rule_list_teaches_nothing(spark):
    """All pages of net/es/ are blocked by the list; a site seen only there gets no rule of its own."""
    pages = spark.createDataFrame([(i, f"http://bad.net/es/{i}") for i in range(200)] + [(200 + i, f"http://bad.org/es/{200 + i}") for i in range(200)], PAGES)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], LABELS)
    assert {(r.page_id < 200, r.verdict) for r in url_filter.judge(pages, labels).collect()} == {(True, "block"), (False, "allow")}


def test_tables_teach_no_rule(spark, sf):
    got = url_filter.held_out(spark.read.parquet(f"{sf}/../sf0.1/pages.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")).first()
    assert got.pages > 80 and got.bad > 10 and got.blocked == 0


def test_odd_labels_and_wide_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST", 5)
    long = "/".join(f"s{i}" for i in range(60))
    chain = ["/".join(f"t{i}" for i in range(20 + n % 30)) for n in range(60)]
    urls = [f"http://w{i % 2}.org/{long}/{i}" for i in range(60)] + [f"http://v.org/{c}/{60 + i}" for i, c in enumerate(chain)] + [f"http://bad.org/{120 + i}" for i in range(60)]
    pages = spark.createDataFrame([*enumerate(urls), (None, None), (None, "http://bad.org/7"), (3, urls[130]), (3, urls[130])], PAGES).withColumn("tokens", F.lit("clash")).withColumn("block", F.lit(1))
    labels = [(i, int(i < 120), 0) for i in range(180)] + [(i, 1, 0) for i in range(180)] + [(None, 0, 1), (7, None, None)]
    got = url_filter.judge(pages, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 184 and all((r.verdict == "block") == ("bad.org" in r.host) for r in got)
    assert url_filter.judge(pages, spark.createDataFrame([(None, None, None)], LABELS)).where("verdict = 'block'").count() == 0
