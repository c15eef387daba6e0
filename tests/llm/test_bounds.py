"""What must not grow with the table, or with one frequent key."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import base, langid, lm, neardup, queries, secrets, topk

SMALL = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_words"], round(r["log_score"], 6)) for r in df.collect())


def test_frequent_ngrams_change_the_work_only(documents, monkeypatch):
    """Many blocks, with frequent n-grams and without, against one block."""
    one = as_rows(lm.score(documents.coalesce(1)))
    many = documents.repartition(9)
    with_ = as_rows(lm.score(many))
    monkeypatch.setattr(lm, "FREQUENT", 0)
    assert as_rows(lm.score(many)) == with_ == one


def test_frequent_ngrams_leave_no_row_a_block(spark, monkeypatch):
    """A word of every block is counted by one row a task."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same words "), F.col("id").cast("string")).alias("text")).repartition(8)
    seen = []
    monkeypatch.setattr(lm, "written", lambda df, tag, **kw: (seen.append((tag, df)), written(df, tag, **kw))[1])
    written = __import__("fathom.llm.base", fromlist=["written"]).written
    lm.score(docs)
    rows = [df for tag, df in seen if tag == "counts"]
    assert sum(df.where("block >= 0").count() for df in rows) == 0
    assert {r["n"] for df in rows for r in df.where("block < 0").collect()} >= {400}


def test_files_hold_few_blocks(spark, monkeypatch):
    """Seven blocks of one task: files of four at most."""
    docs = spark.range(12_000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id").cast("string")).alias("text"))
    seen = []
    monkeypatch.setattr(lm, "written", lambda df, tag, **kw: (made := base.written(df, tag, **kw), seen.append((tag, made)))[0])
    assert lm.score(docs).count() == 12_000
    (cut,) = [made for tag, made in seen if tag == "blocks"]
    sizes = [r["n"] for r in cut.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 7 and max(sizes) <= lm.FILE_BLOCKS


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_samples_are_bounded_by_rows(spark, n):
    """What gets past the filter ahead of the last sort is about twice the sample."""
    most = 500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    plan = secrets.samples(docs, most)._jdf.queryExecution().optimizedPlan().toString()
    bound = int(plan.split("<= ")[1].split(")")[0])
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) <= bound).count()
    assert 1.5 * most < rows < 2.5 * most + 1500


def test_a_language_model_of_many_rows_takes_its_sample(spark):
    """5,000 rows of two languages, 200 texts to learn from."""
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(20))
    docs = spark.createDataFrame([(k, text("abcdefgh") if k % 2 else text("qrstuvwxyz"), "xa" if k % 2 else "xb") for k in range(5000)], "doc_id long, text string, lang string")
    found = langid.identify(docs, sample=200).collect()
    assert np.mean([r["lang_pred"] == ("xa" if r["doc_id"] % 2 else "xb") for r in found]) == 1.0


def tokens(rng, n):
    """(token, whether it is random): base-64 keys and what prose and code have of that length."""
    syllables = ["ta", "ble", "con", "fig", "ser", "ver", "user", "na", "me", "in", "dex", "re", "quest", "han", "dler", "the", "tion", "ing", "and"]
    words = lambda k: [rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables) for _ in range(k)]
    for _ in range(n):
        yield "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(20, 40))), True
        yield rng.choice(["_".join(words(4)), "".join(w.capitalize() for w in words(4)), "-".join(words(4)), "/".join(words(5)), "".join(words(4)), "".join(rng.choice(string.digits) for _ in range(16)), "=" * 30])[:40], False


def test_precision_and_recall_of_the_models(spark):
    """The models of the query's sample and its thresholds, on random tokens beside long identifiers."""
    planted = [(t, r) for t, r in tokens(random.Random(4), 1000) if len(t) >= 16]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    table = secrets.weights(secrets.samples(docs)).scalar()
    rows = spark.createDataFrame(planted, "value string, random boolean").withColumn("t", table).select("value", "random", secrets.likelihood(F.col("value"), F.col("t")).alias("ll"))
    hit = rows.withColumn("hit", (F.col("ll") >= secrets.SUM) & (F.col("ll") >= secrets.MEAN * (F.length("value") - 1)))
    n = hit.agg(F.sum((F.col("hit") & F.col("random")).cast("long")).alias("both"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum(F.col("random").cast("long")).alias("all")).first()
    assert n["both"] / n["all"] >= 0.99 and n["both"] / n["hits"] >= 0.99


def test_recall_where_the_sample_holds_random_tokens(spark):
    """500 random tokens in documents that the models learn from, and as many long identifiers."""
    planted = [(k, t, r) for k, (t, r) in enumerate(tokens(random.Random(4), 500)) if len(t) >= 16]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = spark.createDataFrame([(1_000_000 + k, f"see {t} here") for k, t, _ in planted], "doc_id long, text string")
    found = {r["doc_id"] - 1_000_000 for r in secrets.scan(docs.union(more)).where(F.exists("spans", lambda s: s["kind"] == "random")).select("doc_id").collect()}
    right = {k for k, _, random_ in planted if random_}
    print(len(found & right) / len(right), len(found & right) / max(1, len(found)))
    assert len(found & right) / len(right) >= 0.95 and len(found & right) / len(found) >= 0.95


def test_the_queries_sample_no_more(spark):
    assert queries.op7_secrets(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_an_outlier_does_not_branch_a_group_of_copies(spark, monkeypatch):
    """600 copies of a text; the smallest ids of their nodes share 40 % with them."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:120], *(f"o{k}_{j}" for j in range(80))])) for k in range(10)]
    rows += [(k, " ".join([*base[: k % 200], f"x{k}", *base[k % 200 + 1 :]])) for k in range(10, 610)]
    seen, written = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, tag, **kw: (seen.append(tag), written(df, tag, **kw))[1])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == (10 if r["doc_id"] >= 10 else r["doc_id"]) for r in found)
    assert seen.count("alike") == 1 and seen.count("nodes") == 1


def test_no_probes_go_through_the_driver(spark, monkeypatch):
    """Only the list of crowded buckets may be broadcast, however small Spark takes the rest to be."""
    rng, plans = random.Random(4), []
    df = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(300)], "id long, code long")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(topk, "written", lambda df, tag: (plans.append((tag, plan(df))), base.written(df, tag))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = topk.top_k(df, df.where("id % 50 = 0"), 3)
        assert found.count() == 18
        plans.append(("result", plan(found)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = [(tag, p.count("BroadcastHashJoin")) for tag, p in plans]
    assert {tag for tag, n in sent if n} <= {"index", "found"} and max(n for _, n in sent) <= 1
