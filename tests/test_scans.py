"""Data sources over files, page extraction, sentiment shares and checkpointed loads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fathom.functions import words
from fathom.operators import articles as A
from fathom.operators import sentiment as N
from fathom.sources import crawl, files, html, pages, scan
from fathom.streaming import ingest

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Articles of 100 days as pages of three rows in windows of ten days."""
    path = str(tmp_path_factory.mktemp("pages"))
    rows = [(k, DAY + dt.timedelta(k % 100), f"t{k}" if k % 5 else None, "b", "xy"[k % 2], scan.IMPORTANCE[k % 3]) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, created date, title string, body string, topic string, importance string")
    scan.write_article_pages(df, f"file://{path}", "2024-01-01", days=9, size=3)
    return df, path


def read(spark, path, **options):
    return scan.scan(spark, scan.ArticlePages, f"file://{path}", **{"days": 9, "pageSize": 3} | options)


def test_every_page_is_read(spark, stored):
    df, path = stored
    found = read(spark, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert found.rdd.getNumPartitions() == 10
    assert read(spark, path, first="2024-02-01", last="2024-02-29").count() == df.where("created between '2024-02-01' and '2024-02-29'").count()


def test_filters_open_fewer_files(spark, stored, tmp_path):
    """Files that a filter rules out can't be parsed: reading them would fail."""
    import shutil

    df, path = stored
    copy = tmp_path / "copy"
    shutil.copytree(path, copy)
    for file in copy.rglob("part-*.json"):
        start = dt.date.fromisoformat(file.parts[-5].removeprefix("start="))
        wanted = dt.date(2024, 1, 21) <= start <= dt.date(2024, 2, 10) and "topic=x" in str(file) and "importance=low" not in str(file)
        if not wanted:
            file.write_text("{broken")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    condition = "created >= '2024-01-21' and created < '2024-02-20' and topic = 'x' and importance in ('medium', 'high')"
    found = read(spark, copy).where(condition)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in df.where(condition).collect())
    with pytest.raises(Exception, match="JSON|Expecting"):
        read(spark, copy).where("created >= '2024-01-21'").count()
    assert read(spark, copy).where("importance = 'none'").count() == 0


def test_a_short_page_ends_a_window(spark, stored):
    """With a larger page size the first page is short: later ones are not asked for."""
    df, path = stored
    assert read(spark, path, pageSize=4).count() == sum(min(3, r["count"]) for r in df.withColumn("w", F.floor(F.datediff("created", F.lit(DAY)) / 10)).groupBy("w", "topic", "importance").count().collect())


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert scan.retried(flaky, wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        scan.retried(lambda: (_ for _ in ()).throw(OSError("down")), wait=lambda _: None)
    assert scan.retried(lambda: open("/none/there")) is None


def test_series_by_offsets(spark, tmp_path):
    rows = [(s, DAY + dt.timedelta(7 * k), None if k == 4 else float(k)) for s in ("a", "b") for k in range(11)]
    df = spark.createDataFrame(rows, "series string, date date, value double")
    scan.write_series_pages(df, f"file://{tmp_path}/s", 4)
    found = scan.scan(spark, scan.SeriesPages, f"file://{tmp_path}/s")
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[2] is not None) and found.rdd.getNumPartitions() == 2
    some = found.where("series = 'b' and date > '2024-02-01'")
    assert some.count() == 6 and some.rdd.getNumPartitions() == 1
    import shutil

    shutil.rmtree(tmp_path / "s/series=b/offset=8")
    with pytest.raises(Exception, match="no page at 8 of 11"):
        found.where("series = 'b'").count()


def test_sitemaps_of_other_months_are_not_opened(spark, tmp_path):
    path = tmp_path / "maps"
    path.mkdir()
    for month in (1, 2, 3, 12):
        (path / f"sitemap_articles_2024_{month}.xml").write_text(f"<urlset><url><loc>https://s.com/E/{month}.html</loc></url></urlset>" if month in (2, 3) else "<urlset><url><loc>")
    (path / "other.xml").write_text("<urlset><url><loc>/E/other.html</loc><lastmod>2024-02-09T01:00:00Z</lastmod></url></urlset>")
    found = files.sitemap_urls(spark, str(path), "s.com", "2024-02-03", "2024-03-09", ["/E/"], [])
    assert {r["url"] for r in found.collect()} == {"https://s.com/E/2.html", "https://s.com/E/3.html", "https://s.com/E/other.html"}
    opened = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", "true").schema("loc string").load(str(path))
    assert opened.where(files._between(files._month(F.col("_metadata.file_path")), "2024-02-03", "2024-03-09")).rdd.getNumPartitions() <= 2


PAGE = """<html><head><meta property="article:author" content=" Ann Lee "><meta name="date" content="Mon, 01 Jan 2024 23:30:00 -0400">
<style>p{{}}</style></head><body><nav><a href="/">Home</a><a>Oil</a><div class="x breadcrumb"><a> Prices </a><a></a></div></nav><p>{out}</p><h1> The <b>first</b> one</h1><h1>second</h1>{main}</body></html>"""
LONG = "a paragraph with enough letters to count as text, number "
ARTICLES = {
    "article": PAGE.format(out=LONG + "0", main=f"<div class='content'><p>{LONG}1</p></div><article><p>{LONG}2 <i>in</i>side</p><p>short</p><p>Read more: {LONG}</p></article>"),
    "div": PAGE.format(out=LONG + "0", main=f"<div class='side'><p>{LONG}1</p></div><div class='big Main-Story'><div><p>{LONG}2</div></div><main><p>{LONG}3</p></main>"),
    "main": PAGE.format(out=LONG + "0", main=f"<main><p>{LONG}3<p>{LONG}4</main><p>{LONG}5</p>"),
    "page": PAGE.format(out=LONG + "0", main=f"<section><p>{LONG}6</p></section>").replace("h1", "h2"),
    "shown": f"<body><script>Not Me | Feb 1, 2024</script><div>By</div><span>nobody</span> <b>Jane Doe | Mar 14, 2024, 5:30 PM CST</b><p>{LONG}7</p></body>",
    "linked": '<script type="application/ld+json">[1]</script><script type="application/ld+json">{broken</script><script type="application/ld+json">{"dateCreated": "2024-01-05T10:00:00Z"}</script><meta name="author" content="">',
    "none": None,
}


def test_articles_with_each_fallback(spark):
    df = spark.createDataFrame([(k, "u", v) for k, v in ARTICLES.items()], "page_id string, url string, html string")
    found = {r["page_id"]: r for r in pages.articles(df).collect()}
    assert found["article"]["title"] == found["div"]["title"] == "The first one" and found["page"]["title"] is None
    assert found["article"]["author"] == "Ann Lee" and found["article"]["published_at"] == "2024-01-01T23:30:00-04:00"
    assert found["article"]["section"] == "Home > Oil > Prices"
    bodies = {k: [line[-12:] for line in (r["body"] or "").split("\n")] for k, r in found.items()}
    tail = lambda t: (LONG + t)[-12:]
    assert bodies["article"] == [f"{LONG}2 in side"[-12:]] and bodies["div"] == [tail("2")] and bodies["main"] == [tail("3"), tail("4")] and bodies["page"] == [tail("0"), tail("6")]
    assert (found["shown"]["author"], found["shown"]["published_at"]) == ("Jane Doe", "Mar 14, 2024, 5:30 PM CST")
    assert (found["linked"]["author"], found["linked"]["published_at"]) == (None, "2024-01-05T10:00:00+00:00")
    assert tuple(found["none"])[2:] == (None, None, None, None, "")


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "x" + "</p></b>" * 3
    assert html.tree(deep).text() == "x" and html.tree("<p>a<br>b</p><p>c<p>d").text("|") == "a|b|c|d"
    assert [e.tag for e in html.tree("<p>a<p>b<div><p>c</div>").walk()] == ["p", "p", "div", "p"]


def test_listing(spark):
    page = '<div>Before <a href="/c/one.html">A title of twenty letters</a> and after</div><a href="https://site.com/c/one.html">The same address once more</a><p><a href="two.html">Another title of letters</a></p><a href="/search/x.html">A title of twenty letters</a><a href="/c/x.htm">A title of twenty letters</a><a href="/c/y.html">short</a><a>A title without address here</a><a href="mailto:x.html">A title of twenty letters</a>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    found = {r["url"]: (r["title"], r["excerpt"]) for r in pages.listing(df, "https://site.com").collect()}
    assert found == {"https://site.com/c/one.html": ("A title of twenty letters", "Before A title of twenty letters and after"), "https://site.com/two.html": ("Another title of letters", None)}


def test_shares_of_texts(spark):
    rows = spark.createDataFrame([(1, "Good good", "", "bad " * 100), (2, None, None, None), (3, "neither word here", None, ""), (4, "A", "b", "!!")], "id int, title string, teaser string, body string")
    found = {r["id"]: r for r in N.score_sentiment(rows, N.shares(["good"], ["bad"], ())).collect()}
    assert abs(found[1]["positive"] - 2 / 77) < 1e-12 and abs(found[1]["negative"] - 75 / 77) < 1e-12  # 300 characters of the body
    assert (found[2]["positive"], found[2]["neutral"], found[2]["sentiment"]) == (0.0, 1.0, 0.0) and found[3]["neutral"] == 1.0
    again = N.score_sentiment(N.score_sentiment(rows), lambda text: F.struct(F.lit(9.0).alias("positive")))
    assert again.columns == [*rows.columns, "positive", "negative", "neutral", "sentiment"] and again.where("positive = 9").count() == 0
    rise = next(w for w in words.MARKET_POSITIVE if w.isalpha() and len(w) > 3)
    df = spark.createDataFrame([(1, rise, None, None)], "id int, title string, teaser string, body string")
    assert N.score_sentiment(df).first()["sentiment"] == 1.0
    assert "Exchange" not in N.score_sentiment(rows)._jdf.queryExecution().executedPlan().toString()


def test_windows_of_articles(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 3, 5),), (None,)], "date date")
    assert [tuple(r) for r in A.by_window(df).orderBy("start").collect()] == [(dt.date(2024, 1, 1), dt.date(2024, 1, 31), 2), (dt.date(2024, 2, 1), dt.date(2024, 3, 2), 0), (dt.date(2024, 3, 3), dt.date(2024, 3, 5), 1)]
    assert A.by_window(df.limit(0)).count() == 0


def test_dates_of_scraped_pages(spark):
    texts = ["2024-01-05", "2024-01-05T23:00:00Z", "Fri, 05 Jan 2024 10:00:00 +0000", "Jan 05, 2024", "Jan 5, 2024, 5:30 PM CST", "January 5, 2024", " 2024-01-05 soon", "soon", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, published_at string").select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), F.lit("h").alias("headline"), F.lit("a").alias("author"), "published_at", F.lit("b").alias("body_text"))
    found = A.from_scraped(df).collect()
    assert len(found) == 7 and {(r["date"], r["title"], r["teaser"]) for r in found} == {(dt.date(2024, 1, 5), "h", "h")} and len({r["id"] for r in found}) == 7


def test_checkpointed_load(spark, tmp_path):
    """A batch that breaks off, a restart, marks of failures, and no row twice."""
    at = lambda name: str(tmp_path / name)
    put = lambda name, rows: spark.createDataFrame(rows, "url string, n int").coalesce(1).write.parquet(at(f"in/{name}"))
    put("1", [("a", 1), ("b", -1), ("b", 2), ("c", -3), (None, 4)])
    put("2", [("a", 9), ("d", 4), ("e", -5)])
    broken = {"left": 1}
    real = ingest.keep_first

    def fails(rows, keys, order):
        if broken["left"] and rows.where("url = 'd'").count():
            broken["left"] = 0
            raise OSError("the second batch breaks off")
        return real(rows, keys, order)

    error = F.when(F.col("n") < 0, "negative")
    load = lambda **kw: ingest.checkpointed(spark, at("in/*"), "url string, n int", at("target"), at("state"), at("checkpoint"), error=error, files=1, **kw)
    ingest.keep_first = fails
    try:
        with pytest.raises(Exception, match="breaks off"):
            load().awaitTermination()
        load().awaitTermination()
    finally:
        ingest.keep_first = real
    target = lambda: sorted((r["url"], r["n"]) for r in spark.read.parquet(at("target")).collect())
    state = lambda: sorted((r["url"], r["error"] or "") for r in spark.read.parquet(at("state")).select("url", "error").distinct().collect())
    first = [x for x in target() if x[0] != "a"]
    assert first == [("b", 2), ("d", 4)] and [x[0] for x in target()].count("a") == 1
    assert state() == [("a", ""), ("b", ""), ("c", "negative"), ("d", ""), ("e", "negative")]
    put("3", [("c", 7), ("e", -1), ("f", 8)])
    load().awaitTermination()
    assert ("c", 7) not in target() and ("f", 8) in target() and len(target()) == 4
    put("4", [("c", 7), ("a", 0)])
    load(again=True).awaitTermination()
    assert ("c", 7) in target() and len(target()) == 5 and json.dumps(state()).count("negative") == 2


def crawl_by_hand(cards, categories, most):
    seen, out = set(), []
    for c in dict.fromkeys(categories):
        for p in range(1, most + 1):
            new = []
            for url, headline in sorted((u, h) for cc, pp, u, h in cards if cc == c and pp == p):
                if url not in seen:
                    seen.add(url)
                    new.append((c, p, url, headline))
            out += new
            if not new:
                break
    return sorted(out)


def test_crawl_stops_where_nothing_is_new(spark):
    import random

    rng = random.Random(3)
    cards = [(rng.choice("abc"), rng.randint(1, 9), f"u{rng.randint(0, 25)}", f"h{rng.randint(0, 3)}") for _ in range(120)]
    cards = [c for c in cards if not (c[0] == "b" and c[1] == 4) and c[0] + str(c[1]) != "c1"] + [("d", 1, "only", "h")]
    df = spark.createDataFrame(cards, "category string, page int, url string, headline string")
    for order, most in ((["a", "b", "c", "d"], 8), (["c", "b", "b", "a"], 15), (["none"], 3)):
        found = [tuple(r) for r in crawl.discovered(df, order, most).select("category", "page", "url", "headline").collect()]
        assert sorted(found) == crawl_by_hand(cards, order, most)
    assert crawl.discovered(df, []).count() == 0


def test_relevant_articles(spark):
    cards = spark.createDataFrame([("c", 1, "u1", "Crude exports and a refinery shutdown"), ("c", 1, "u2", "A quiet day"), ("c", 2, "u3", "Oil pipeline")], "category string, page int, url string, headline string")
    body = "The tanker carried inventories of barrels through the strait for a week"
    pages_ = spark.createDataFrame([("u1", f"<h1>T</h1><article><p>{body}</p></article>"), ("u2", "<h1>no</h1>")], "url string, html string")
    found = {r["url"]: r for r in crawl.relevant_articles(cards, pages_).collect()}
    assert set(found) == {"u1", "u3"} and found["u1"]["body"] == body and found["u3"]["body"] is None and found["u3"]["fulltext_topics"] is None
    assert found["u1"]["headline_topics"] == "refining,flows" and set(found["u1"]["fulltext_topics"].split(",")) == {"inventory", "refining", "flows"}
    assert "tanker" in found["u1"]["fulltext_keyword_matches"].split(",") and "tanker" not in found["u1"]["headline_keyword_matches"] and found["u1"]["headline_score"] > found["u3"]["headline_score"]
