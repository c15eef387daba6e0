import datetime as dt
import itertools
import math
import os

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import articles as A
from fathom.operators import backtest as B
from fathom.operators import boosting
from fathom.operators import daily as D
from fathom.operators import indicators as I
from fathom.operators import keywords as K
from fathom.operators import lexicon as L
from fathom.operators import paragraphs as G
from fathom.operators import regimes as R
from fathom.operators import series as S
from fathom.plans import queries as Q
from fathom.sources import files, pages, scratch, tables
from fathom.streaming import ingest


def test_friday(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (4, 5, 6)], "d date")
    assert [r[0].day for r in days.select(S.friday(F.col("d"))).collect()] == [5, 5, 12]


def test_empty_week(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 1, 19), 3.0)], "date date, x double")
    found = S.weekly(rows, {"n": F.count("x"), "x": F.avg("x")}, ("n",)).orderBy("date").collect()
    assert [(r["n"], r["x"]) for r in found] == [(1, 1.0), (0, None), (1, 3.0)]
    assert S.weekly(rows.limit(0), {"n": F.count("x")}, ("n",)).count() == 0


def test_decay(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "date int, x double")
    found = [r["y"] for r in S.decayed(rows, {"y": "x"}).orderBy("date").collect()]
    assert np.allclose(found, [1, math.exp(-0.25), 2 + math.exp(-0.5)])


def test_decay_over_many_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=900)
    rows = spark.createDataFrame([(k, "ab"[k % 2], float(v)) for k, v in enumerate(x)], "date int, s string, x double")
    found = {(r["s"], r["date"]): r["y"] for r in S.decayed(rows, {"y": "x"}, by=("s",), n=1).collect()}
    for s in range(2):
        y = 0.0
        for k in range(s, 900, 2):
            y = x[k] + math.exp(-1) * y
            assert math.isclose(found["ab"[s], k], y, rel_tol=1e-9, abs_tol=1e-12)


def test_direction(spark):
    rows = spark.createDataFrame([("Oil prices rise and fall",), ("Oil rises",), ("Crude falls, analysts say",), ("Shares rise",), (None,)], "h string")
    assert [r[0] for r in rows.select(T.direction(F.col("h"))).collect()] == [None, "rise", None, None, None]


def test_paragraphs(spark):
    long = "x" * 59 + ". " + "y" * 200 + ". " + "z" * 70
    rows = spark.createDataFrame([("a" * 60 + "\n \n" + "b" * 59,), (long,), (None,), ("",)], "t string")
    found = [r[0] for r in rows.select(T.paragraphs(F.col("t"))).collect()]
    assert found == [["a" * 60], ["x" * 59 + ". " + "y" * 200 + ".", "z" * 70], [], []]


def test_article_time(spark):
    rows = spark.createDataFrame([("Mon, 01 Jan 2024 23:30:00 -0400",), ("2024-01-05T10:00:00Z",), ("no",), (None,)], "t string")
    assert [r[0] and r[0].isoformat() for r in rows.select(T.article_time(F.col("t")).cast("string").cast("timestamp_ntz")).collect()] == ["2024-01-02T03:30:00", "2024-01-05T10:00:00", None, None]


def test_merged_keeps_the_first(spark):
    a = spark.createDataFrame([(1, "2024-01-01", "a")], "id int, date string, x string")
    b = spark.createDataFrame([(1, "2023-01-01"), (2, "2024-01-02")], "id int, date string")
    assert {(r["id"], r["x"]) for r in A.merged(a, b).collect()} == {(1, "a"), (2, None)}


def test_indicators_sum_to_shares(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), 0.5, ["a", "b"]), (dt.date(2024, 1, 2), 0.1, []), (dt.date(2024, 1, 30), 0.2, ["a"])], "date date, sentiment double, topics array<string>")
    found = {(r["week"].day, r["category"]): r for r in I.weekly_indicators(rows, ["a", "b"]).collect()}
    assert found[5, "a"]["intensity"] == 0.25 and found[2, "b"]["intensity"] == 0
    assert found[2, "a"]["decay"] == round(0.2 + 0.5 * math.exp(-0.25), 6)  # observed weeks count, not calendar weeks
    assert found[5, "a"]["variance"] == 0 and found[2, "b"]["decay"] == round(0.5 * math.exp(-0.25), 6)


def test_assignment():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.normal(size=(4, 4))
        best = max(sum(m[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
        assert math.isclose(sum(m[i, j] for i, j in enumerate(R.assignment(m))), best)


def test_hidden_markov_recovers_states():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 2, 0, 2], 60)
    x = np.column_stack([rng.normal(size=300), rng.normal(truth * 4.0, 0.5)])
    path, post, seen = R.markov.hidden_markov(x)
    assert (path == truth).mean() > 0.97 and np.allclose(post.sum(axis=1), 1)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(seen))


def test_rule_scores_of_constant_and_missing_columns(spark):
    rows = spark.createDataFrame([(1, 2.0, None), (2, 2.0, None)], "date int, x double, y double")
    found = R.rule_scores(rows, {"a": {"x": 1.0}, "b": {"y": 1.0, "none": 1.0}}, "c").collect()
    assert all(r["regime"] == "a" and math.isclose(r["regime_prob_a"], 1 / 3) for r in found)


def test_inner_splits():
    assert S.inner_splits(130) == [104] and S.inner_splits(129) == [] and S.inner_splits(230) == [104, 154, 204]


@pytest.mark.parametrize("n", [10, 129, 130, 131, 200, 375])
def test_inner_splits_as_rows(spark, n):
    assert sorted(r["e"] for r in S.inner_split_rows(spark.createDataFrame([(n,)], "n long")).collect()) == S.inner_splits(n)


def test_months_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 3), "old"), (2, dt.date(2024, 2, 3), "old")], "id int, date date, x string").withColumn("query_strategy", F.lit("s"))
    path = str(tmp_path / "t")
    tables.write_months(rows, path)
    new = spark.createDataFrame([(1, dt.date(2024, 1, 9), "new"), (3, dt.date(2024, 1, 9), "new")], "id int, date date, x string").withColumn("query_strategy", F.lit("s"))
    tables.upsert_months(new, path, str(tmp_path / "s"))
    assert {(r["id"], r["x"]) for r in tables.read_months(spark, path).collect()} == {(1, "old"), (2, "old"), (3, "new")}
    assert tables.read_months(spark, path, "2024-02").count() == 1


def test_incremental_load(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(u,) for u in part], "url string").coalesce(1).write.mode("append").parquet(source)
        ingest.incremental(spark, source, "url string", target, checkpoint).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_weekly_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, 5, 12), 1.0), (dt.datetime(2024, 1, 6, 1), 3.0)], "ts timestamp, value double").write.parquet(source)
    q = ingest.weekly_counts(spark.readStream.schema("ts timestamp, value double").parquet(source)).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["week"].day, r["n"]) for r in spark.table("weekly").collect()) == [(5, 1), (12, 1)]


def test_all_seeds_and_rows(spark):
    folder = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["seed"] for r in Q.QUERIES["L2_neighbours_of_all"](spark, folder).collect()} == ids
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert Q.QUERIES["U1_S11_union_of_all"](spark, folder).count() == Q.QUERIES["K2_upsert_of_all"](spark, folder).count() == n


def test_all_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)] + [(60 + k, [1.0, 2.0, 3.0, 4.5]) for k in range(20)]
    vectors = spark.createDataFrame([*rows, (90, None)], "word long, vector array<float>")
    seeds = vectors.where("word % 7 = 0").withColumnRenamed("word", "seed")
    told = lambda df: sorted(tuple(r) for r in df.select("seed", "rank", "word", "similarity").collect())
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors.where("vector is not null").collect()}
    want = [(s, n, w) for s in unit if s % 7 == 0 for n, w in enumerate(sorted((w for w in unit if w != s), key=lambda w: (-round(float(unit[s] @ unit[w]), 9), w))[:3], 1)]
    found = told(K.all_neighbours(vectors, seeds, 3, block=4, part=9))
    assert [r[:3] for r in found] == sorted(want) and found == told(K.all_neighbours(vectors, seeds, 3))


def test_all_pmi(spark):
    index = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("c", 2), ("d", 3)], "token string, doc_id long")
    assert {(r["word"], r["seed"]): round(r["pmi"], 6) for r in K.all_pmi(index, ["a", "b"]).collect()} == {("b", "a"): round(math.log2(1.5), 6), ("a", "b"): round(math.log2(1.5), 6), ("c", "a"): round(math.log2(1.5), 6), ("c", "b"): round(math.log2(1.5), 6)}


def test_paragraphs_have_weak_labels(spark):
    rows = Q.QUERIES["F11_M4_paragraphs"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["weak_labels"] == [k for k, words in Q.TOPICS.items() if any(w in r["paragraph_text"].lower() for w in words)] for r in rows)
    assert any(r["weak_labels"] for r in rows)


def test_flags_of_a_day_with_one_article(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), "Output DEAL near", 0.5), (2, dt.date(2024, 1, 4), None, 0.1), (3, dt.date(2024, 1, 4), "x", 0.3)], "id int, date date, title string, sentiment double")
    found = {r["date"].day: r for r in D.event_flags(rows, "opec", ["deal"]).collect()}
    assert found[1]["opec_sentiment_std"] == 0 and found[1]["opec_decision_day"] == 1 and found[4]["opec_decision_day"] == 0 and found[4]["opec_article_count"] == 2
    other = D.event_flags(rows, "disruption", count="intensity")
    assert "disruption_intensity" in other.columns and "disruption_decision_day" not in other.columns


def test_rules_of_signals(spark):
    rows = spark.createDataFrame([(1, 10.0, 2.0, "macro"), (2, -10.0, -0.5, "demand"), (3, 10.0, -3.0, "demand"), (4, 10.0, 0.0, "demand")], "date int, y_true double, y_pred double, regime string")
    last = B.signal(rows).where("date = 4").first()
    assert math.isclose(last["growth_buyhold"], 1.1 * 0.9 * 1.1 * 1.1) and math.isclose(last["growth_naive"], 1.1)
    assert math.isclose(last["growth_filtered"], 1.1 * 0.9) and math.isclose(last["growth_regime_filtered"], 0.9)
    assert B.trades(B.signal(rows)).first().asDict() == {"n": 4, "n_trades": 2, "n_long": 1, "n_short": 1, "dir_acc": 0.5}


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = np.where(x[:, 2] > 0.3, 2.0, -1.0) + 0.5 * (x[:, 4] > 0) + rng.normal(0, 0.1, 300)
    for settings in ({}, {"absolute": True, "held": 0.1, "rounds": 400}):
        model = boosting.fit(x[:200], y[:200], **settings)
        assert np.abs(model.predict(x[200:]) - y[200:]).mean() < 0.25
        found = boosting.importance(model, x[200:], y[200:], 3)
        assert found.argsort()[::-1][:2].tolist() == [2, 4]
    one = boosting.fit(x, y, depth=1, rounds=1, rate=1.0, leaf=20, l2=0.0)
    cuts = one.cuts[int(one.trees[0][0][0])]
    best = min((((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum(), j) for j in range(6) for c in boosting.fit(x, y, rounds=0).cuts[j] for m in [x[:, j] <= c] if min(m.sum(), (~m).sum()) >= 20)
    assert best[1] == int(one.trees[0][0][0]) == 2 and math.isclose(((one.predict(x) - y) ** 2).sum(), best[0]) and len(cuts) < 64
    assert np.ptp(boosting.fit(x, y, leaf=200).predict(x)) == 0


def test_phrases(spark):
    docs = spark.createDataFrame([(k, ["red", "sea", "port", "red", "sea", f"w{k}"]) for k in range(20)] + [(99, []), (98, ["red"])], "doc_id int, tokens array<string>")
    found = K.phrases(docs, least=5, threshold=0.1)
    assert {(r["a"], r["b"]) for r in found.collect()} == {("red", "sea"), ("sea", "port"), ("port", "red")}
    tokens = [r["token"] for r in K.phrased(docs, found).where("doc_id = 3").orderBy("pos").collect()]
    assert tokens == ["red_sea", "port_red", "sea", "w3"]
    seeds = spark.createDataFrame([("Red Sea",), ("port",), ("a b",)], "seed string")
    assert {r["seed"]: r["token"] for r in K.seed_tokens(seeds, found).collect()} == {"Red Sea": "red_sea", "port": "port"}


def test_word_vectors(spark):
    rows = [(k, p, w) for k in range(60) for p, w in enumerate((["oil", "crude", "barrel"] if k % 2 else ["cat", "dog", "mouse"]) * 3)]
    found = {r["word"]: np.array(r["vector"]) for r in K.word_vectors(spark.createDataFrame(rows, "doc_id int, pos int, token string"), size=16, rounds=5).collect()}
    assert set(found) == {"oil", "crude", "barrel", "cat", "dog", "mouse"} and all(len(v) == 16 for v in found.values())
    often = spark.createDataFrame(rows + [(99, 0, "rare"), (99, 1, "rare")], "doc_id int, pos int, token string")
    assert {r["word"] for r in K.word_vectors(often, size=4, rounds=1, parts=3).collect()} == set(found)  # every token that comes three times


def test_word_vectors_by_buckets(spark, monkeypatch):
    """No model of Spark ML, which the driver holds whole: buckets of words meet buckets of
    contexts, and words with contexts in common are alike across buckets, also where a bucket is empty."""
    from pyspark.ml.feature import Word2Vec

    monkeypatch.setattr(Word2Vec, "fit", lambda *_: pytest.fail("whole table of parameters"))
    sides = [["oil", "crude", "barrel", "export"], ["cat", "dog", "mouse", "garden"]]
    rng = np.random.default_rng(3)
    rows = [(k, p, str(w)) for k in range(300) for p, w in enumerate(rng.permutation(sides[k % 2] * 3))]
    found = {r["word"]: np.array(r["vector"]) for r in K.word_vectors(spark.createDataFrame(rows, "doc_id int, pos int, token string"), size=16, rounds=4, parts=3).collect()}
    cosine = lambda a, b: found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])
    assert set(found) == {*sides[0], *sides[1]}
    assert all(cosine(a, b) > cosine(a, c) + 0.3 for some, other in (sides, sides[::-1]) for a in some for b in some for c in other)


def test_keywords_from_a_corpus(spark):
    """Planted: words that share contexts with a group's seeds are found, of the other group none."""
    rng, docs = np.random.default_rng(7), []
    one, two = ["crude", "barrel", "refinery", "pipeline", "tanker"], ["kitten", "puppy", "hamster", "rabbit", "parrot"]
    for k in range(600):
        some, frame = (one, ["export", "storage", "terminal"]) if k % 2 else (two, ["feeding", "garden", "basket"])
        words = []
        for _ in range(6):
            words += [rng.choice(some), *rng.permutation(frame)[:2], rng.choice(["the", "with", "from"])]
            words += ["red", "sea"] if k % 2 and rng.random() < 0.3 else []
        docs.append((k, [str(w) for w in words]))
    docs += [(900, []), (901, None)]
    df = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    groups = spark.createDataFrame([("oil", "crude"), ("oil", "barrel"), ("oil", "red sea"), ("oil", "unknown word"), ("pets", "kitten"), ("pets", "puppy")], "group string, seed string")
    found = K.expanded_groups(df, groups, top=8, least=0.3, cosine_least=0.2, pmi_least=0.02, size=24, rounds=8).collect()
    got = {g: {r["word"] for r in found if r["group"] == g} for g in ("oil", "pets")}
    assert {"refinery", "pipeline", "tanker"} <= got["oil"] and {"hamster", "rabbit", "parrot"} <= got["pets"]
    assert not got["oil"] & {*two, "feeding", "garden", "basket"} and not got["pets"] & {*one, "export", "storage", "terminal", "red_sea"}
    assert all(r["similarity"] >= 0.3 and r["mean_cosine"] >= 0.2 and r["mean_pmi"] >= 0.02 and r["word"] not in ("crude", "barrel", "red_sea", "kitten", "puppy") for r in found)
    assert {r["similar_to"] for r in found if r["group"] == "oil"} <= {"crude", "barrel", "red sea"}
    open_ = K.expanded_groups(df, groups, top=8, least=0.3, gated=["pets"], size=24, rounds=8).collect()
    assert all((r["mean_pmi"] is None) == (r["group"] == "oil") for r in open_) and any(r["group"] == "oil" for r in open_)


def test_word_vectors_leave_no_table_for_each_step(spark, monkeypatch):
    """Nine steps: parameters replace older ones, pairs of tokens are not stored, and the vectors
    are those of texts in one part."""
    rng = np.random.default_rng(5)
    rows = [(k, p, f"w{w}") for k in range(60) for p, w in enumerate(rng.integers(0, 30, 12))]
    df = spark.createDataFrame(rows, "doc_id int, pos int, token string")
    folder = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    vectors = lambda: {r["word"]: list(r["vector"]) for r in K.word_vectors(df, size=8, rounds=3, parts=3).collect()}
    found = vectors()
    made = [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before]
    assert made.count("model") == 3 and "pairs" not in made
    monkeypatch.setattr(K, "PARTS", 1)
    assert vectors() == found and len(found) == 30


def test_topics_by_model(spark):
    rng = np.random.default_rng(0)
    text = lambda k: f"{'quota talks opec' if k % 2 else 'inventories stockpile cushing'} " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] if k % 2 else ["one", "two", "three", "four"], 12))
    keywords = {"quota": ["quota"], "stock": ["stockpile"], "rare": ["zzz"]}
    rows = spark.createDataFrame([(k, text(k)) for k in range(80)] + [(100, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta"), (101, ""), (102, None)], "id int, text string")
    found = {r["id"]: r["topics"] for r in G.topics_by_model(rows, keywords=keywords).collect()}
    assert all(found[k] == (["quota"] if k % 2 else ["stock"]) for k in range(80)) and found[100] == ["quota"] and found[101] == found[102] == []
    none = G.topics_by_model(rows.where("id > 99"), keywords=keywords).collect()
    assert all(r["topics"] == [] for r in none)


def test_topics_learn_from_all_paragraphs(spark):
    """No sample: the share of a rare label is exact beyond 100,000 labelled paragraphs."""
    n = 100_500
    labels = F.when(F.col("id") % 5025 == 7, F.array(F.lit("all"), F.lit("rare"))).otherwise(F.array(F.lit("all")))
    frame = spark.range(n).select("id", F.concat(F.lit("some words "), (F.col("id") % 1000).cast("string")).alias("paragraph_text"), labels.alias("weak_labels"))
    assert G.fit_topics(frame, ["all", "rare", "none"]).topics == {"all": 1.0, "rare": 20 / n, "none": 0.0}


def test_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rows = files.csv_articles(spark, put("a.csv", 'headline,body_text,published_at\nOne,"two\nlines",2024-01-05T10:00:00Z\nTwo,x,never\n,y,"Mon, 01 Jan 2024 23:30:00 -0400"\n')).collect()
    assert [(r["headline"], r["text"]) for r in rows] == [("One", "One two\nlines"), ("", "y")]
    page = lambda *p: '{"response": {"total": "4", "data": [' + ", ".join(f'{{"period": "{a}", "value": {b}}}' for a, b in p) + "]}}"
    put("s/1.json", page(("2024-01-05", 1.5), ("2024-01-12", "null")))
    put("s/2.json", page(("2024-01-12", '"2"'), ("2024-01-05", 1.5)))
    assert [tuple(r) for r in files.paged_series(spark, str(tmp_path / "s"), "x").collect()] == [(dt.date(2024, 1, 5), 1.5), (dt.date(2024, 1, 12), 2.0)]
    loc = lambda *u: "<urlset>" + "".join(f"<url><loc>{a}</loc>{f'<lastmod>{b}</lastmod>' if b else ''}</url>" for a, b in u) + "</urlset>"
    leaf = put("leaf.xml", loc(("/E/Oil/a.html", "2024-01-05T00:00:00"), ("site.com/E/Oil/b.html", None), ("https://site.com/E/Coal/c.html", None), ("https://site.com/E/Oil/d.html", "2023-01-01"), ("https://site.com/E/Oil/e.htm", None), ("ftp:x.html", None), ("/E/Oil/a.html", None)))
    assert {r["url"]: r["lastmod"] for r in files.sitemap_urls(spark, leaf, "site.com", "2024-01-01", "2024-12-31", ["/E/"], ["/E/Coal/"]).collect()} == {"https://site.com/E/Oil/a.html": dt.date(2024, 1, 5), "https://site.com/E/Oil/b.html": None}
    index = put("index.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://s/{n}</loc></sitemap>" for n in ("sitemap_articles_2024_1.xml", "sitemap_articles_2023_12.xml", "static.xml", "sitemap_articles_2024_3.xml")) + "</sitemapindex>")
    assert [r["loc"] for r in files.sitemaps(spark, index, "2024-01-01", "2024-02-15").collect()] == ["https://s/sitemap_articles_2024_1.xml"]
    assert files.optional(spark, lambda: spark.read.parquet(str(tmp_path / "none")), "id long").count() == 0
    both = spark.createDataFrame([(1, 2, "https://s/c/Big-News.html")], "a int, p int, u string")
    assert both.select(files.page_url(F.lit("https://s/c//"), F.col("p")).alias("x"), files.page_url(F.lit("https://s/c"), F.col("a")).alias("y"), files.slug_headline(F.col("u")).alias("z")).first() == ("https://s/c/Page-2.html", "https://s/c/", "Big News")
    high = spark.createDataFrame([(1, "high"), (1, "medium"), (2, "low"), (3, "medium")], "id int, importance string")
    assert sorted((r["id"], r["importance"], r["is_important"]) for r in files.important(high).collect()) == [(1, "high", True), (3, "medium", True)]
    raw = put("raw.json", '{"id": 1, "title": "t", "created": "Mon, 01 Jan 2024 23:30:00 -0400", "channels": [{"name": "x"}]}\n{"id": 2, "created": "no", "tags": null}\n')
    found = files.strategies(spark, {"broad": raw, "opec": raw}, {"broad": "wide"}).orderBy("id").collect()
    assert [(r["id"], r["query_strategy"], r["query_tier"], r["channels"], r["date"]) for r in found] == [(1, "broad", "wide", ["x"], dt.date(2024, 1, 2)), (2, "broad", "wide", [], None)]
    for kind in ("csv", "json", "parquet"):
        files.write_table(high, str(tmp_path / f"out.{kind}"), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / f"out.{kind}")).count() == 4
    files.write_table(high.withColumn("date", F.col("id")), str(tmp_path / "deep/x/y"))
    assert files.folder(spark, str(tmp_path / "deep")).count() == 3


def test_pages(spark):
    html = '<script type="application/ld+json">{"x": 1}</script><script type="application/ld+json">{"dateCreated": "2024-01-05"}</script><h1>T <b>x</b></h1><article><p>' + "word " * 12 + "</p><p>Click here " + "word " * 12 + '</p></article><a href="/a/b.html">A long enough title here</a><a href="https://s.com/search/x.html">A long enough title too</a><a href="/a/b.html">Zz the same address again</a>'
    rows = spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id int, url string, html string")
    found = {r["page_id"]: r for r in pages.articles(rows).collect()}
    assert found[1]["published_at"] == "2024-01-05T00:00:00" and found[1]["body"] == ("word " * 12).strip() and found[2]["body"] == ""
    assert [tuple(r) for r in pages.article_links(pages.links(rows), "https://s.com").collect()] == [(1, "https://s.com/a/b.html", "A long enough title here")]


def test_upsert_makes_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 3)), (1, dt.date(2024, 1, 4))], "id int, date date").withColumn("query_strategy", F.lit("s"))
    tables.upsert_months(rows, str(tmp_path / "t"), str(tmp_path / "s"))
    assert [r["date"].day for r in tables.read_months(spark, str(tmp_path / "t")).collect()] == [3]


def test_base_lexicon(spark):
    from fathom.functions import words
    from fathom.operators import lexicon as L

    held = {r["word"]: r["polarity"] for r in L.base_lexicon(spark).collect()}
    assert held["disruption"] == 1.0 and held["excess"] == -1.0  # the market's lists come last
    assert set(held) == {w for some, _ in L.BASE for w in some} and set(words.BASE_POSITIVE) <= set(held)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_topics_lower_a_text_once(spark):
    df = spark.createDataFrame([(1, "OPEC quota"), (2, None), (3, "Snow STORM and OPEC")], "id int, text string")
    found = df.select("id", T.topics(F.col("text"), {"a": ["opec", "x"], "b": ["storm", "y", "z"], "c": ["none"]}).alias("t"))
    assert {r["id"]: r["t"] for r in found.collect()} == {1: ["a"], 2: [], 3: ["a", "b"]}
    assert found._jdf.queryExecution().executedPlan().toString().count("lower(") <= 1
    assert df.select(T.topics(F.col("text"), {}).alias("t")).collect()[0]["t"] == []


def test_words_are_counted_in_their_row(spark):
    """A document's words are shuffled by word only; rows of one id still add up."""
    df = spark.createDataFrame([(1, "oil oil up up up now"), (1, "oil down"), (2, None), (3, "aaa")], "id int, text string")
    lexicon = spark.createDataFrame([("oil", 1.0), ("down", -1.0)], "word string, polarity double")
    got = L.scored(df, lexicon, "id", stop=())
    assert {r["id"]: round(r["lm_sentiment"], 6) for r in got.collect()} == {1: 0.4, 2: 0.0, 3: 0.0}
    assert not re.search(r"hashpartitioning\(id#\d+, word", _plan(got))
    assert [[tuple(c) for c in r["c"]] for r in df.select(T.counted(T.tokens(F.col("text"), ())).alias("c")).collect()] == [[("now", 1), ("oil", 2)], [("down", 1), ("oil", 1)], [], [("aaa", 1)]]


def test_phrased_rows_stay_with_their_document(spark):
    """Tokens don't go by (id, pos) to meet the phrases; only a document's places do, as one row."""
    docs = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["b", "c"]), (3, []), (4, None), (5, ["a", "b", "a", "b"]), (6, ["x"])], "doc_id int, tokens array<string>")
    found = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "a string, b string")
    got = K.phrased(docs, found)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["pos"])):
        by.setdefault(r["doc_id"], []).append((r["pos"], r["token"]))
    assert by == {1: [(0, "a_b"), (2, "c"), (3, "d")], 2: [(0, "b_c")], 5: [(0, "a_b"), (2, "a_b")], 6: [(0, "x")]}
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, pos", _plan(got))


def test_described_without_a_column_in_one_task(spark):
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.integers(0, 400, 999)]
    df = spark.createDataFrame([(v, v / 7 if k % 3 else None, None) for k, v in enumerate(x)], "a double, b double, c double")
    found = S.described(df, ["a", "b", "c"])
    assert "percentile" not in _plan(found)
    got, b = {r["column"]: r for r in found.collect()}, [v / 7 for k, v in enumerate(x) if k % 3]
    for name, some in (("a", x), ("b", b)):
        r = got[name]
        assert r["count"] == len(some) and np.allclose([r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]], [np.mean(some), np.std(some, ddof=1), min(some), *np.quantile(some, [0.25, 0.5, 0.75]), max(some)])
    assert got["c"]["count"] == 0 and got["c"]["q50"] is None


def test_pages_come_in_small_batches(spark):
    pages.articles(spark.createDataFrame([(1, "u", "<h1>a</h1>")], "page_id int, url string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
