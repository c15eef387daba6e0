"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import remainder, table
from fathom.llm.decontaminate import decontaminate
from fathom.llm import bpe, fim, langid, lm, quality, whitening
from fathom.llm.neardup import near_duplicates
from fathom.llm.packing import pack
from fathom.llm.records import tokenized
from fathom.llm.secrets import PATTERNS, as_text, scan
from fathom.llm.sharding import place
from fathom.llm.topk import EVERY, sign_code, top_k


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log_score", "score")))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) > 0)
    return quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, quality_model(spark, docs, sf_dir), with_text=False).select("doc_id", held_out, "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, kind)) for kind in PATTERNS]
    counts = [n.cast("long").alias(f"n_{kind}") for n, kind in zip(counts, PATTERNS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=0).drop("ids")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(rows, rows.where(F.col("id") % EVERY == 0)).withColumnRenamed("id", "vec_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sizes = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (fim.restored(), "restored_sha256"))]
    return found.select("doc_id", "n", "form", *sizes, *digests)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_lm_scores, op3_token_records, op4_decontaminate, op5_quality, op6_language, op7_secrets, op8_pack, op9_near_duplicates, op10_top_k, op11_whitening, op12_fill_in_middle, op13_bpe)}

#: Words of a text as LM scoring and near-duplicate detection take them.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
t AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT rid, i, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS u FROM t),
n1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
o1 AS (SELECT rid, w, count(*) AS n FROM g GROUP BY rid, w),
n2 AS (SELECT v, w, count(*) AS n FROM g WHERE i > 1 GROUP BY v, w),
o2 AS (SELECT rid, v, w, count(*) AS n FROM g WHERE i > 1 GROUP BY rid, v, w),
n3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE i > 2 GROUP BY u, v, w),
o3 AS (SELECT rid, u, v, w, count(*) AS n FROM g WHERE i > 2 GROUP BY rid, u, v, w),
sizes AS (SELECT rid, doc_id, len(w) AS n, sum(len(w)) OVER () AS total FROM d),
c1 AS (SELECT o1.rid, o1.w, n1.n - o1.n AS n FROM o1 JOIN n1 USING (w)),
c2 AS (SELECT o2.rid, o2.v, o2.w, n2.n - o2.n AS n FROM o2 JOIN n2 USING (v, w)),
c3 AS (SELECT o3.rid, o3.u, o3.v, o3.w, n3.n - o3.n AS n FROM o3 JOIN n3 USING (u, v, w)),
s AS (SELECT g.rid, CASE
    WHEN c3.n > 0 THEN ln(c3.n / p2.n::DOUBLE)
    WHEN c2.n > 0 THEN ln(c2.n / p1.n::DOUBLE) + ln(0.4::DOUBLE) * (least(g.i - 1, 2) - 1)
    ELSE ln(greatest(c1.n, 0.5::DOUBLE) / greatest(sizes.total - sizes.n, 1)::DOUBLE) + ln(0.4::DOUBLE) * least(g.i - 1, 2) END AS x
  FROM g JOIN sizes USING (rid) JOIN c1 ON c1.rid = g.rid AND c1.w = g.w
  LEFT JOIN c2 ON c2.rid = g.rid AND c2.v = g.v AND c2.w = g.w
  LEFT JOIN c1 p1 ON p1.rid = g.rid AND p1.w = g.v
  LEFT JOIN c3 ON c3.rid = g.rid AND c3.u = g.u AND c3.v = g.v AND c3.w = g.w
  LEFT JOIN c2 p2 ON p2.rid = g.rid AND p2.v = g.u AND p2.w = g.v),
r AS (SELECT rid, sum(x) AS x FROM s GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / n, 6) AS score
FROM sizes LEFT JOIN r USING (rid)
"""

TOP_K_SQL = """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id, e.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

#: Units as a list, cut by two draws of the id.
FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k::INTEGER + 1, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, len(w) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
    WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM c),
q AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""

ORACLES: dict[str, str] = {"op12_fill_in_middle": FIM_SQL, "op2_lm_scores": LM_SQL, "op10_top_k": TOP_K_SQL}
