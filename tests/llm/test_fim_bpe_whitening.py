"""Fill-in-middle, byte-pair encoding and whitening against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import bpe, fim, queries, whitening

STRANGE = ["\x01", "\x02", "\x021\x020\x01", "a\x01b\x02c0 1", "<P", "<P<S", "x<M>y", "😀é   end", "<|endoftext|>", " <|endoftext|><|endoftext|> a", "a" * 5000, "ab" * 4000, "=" * 3000 + "\n\n\n \t x", "\n", "١٢٣ ४५ Ⅷ ½", "it's I'LL we've", "日本語のテキスト" * 50, "\x00\x7f", "ℵ՘\U000107bb1"]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def strange(spark, documents):
    more = [(1000 + 7 * k + i, t) for k, t in enumerate(STRANGE) for i in range(7)]
    return documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).select("*", F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit(2).alias("_h1"), F.lit("d").alias("decoded"), F.lit(0).alias("ids"))


def test_fill_in_middle(strange, empty):
    found = fim.fill_in_middle(strange).withColumn("back", fim.restored()).collect()
    assert len(found) == strange.count()
    for r in found:
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["output"]) == by_hand(r["doc_id"], r["text"])
        assert r["back"] == r["text"]
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0


def test_fill_in_middle_runs_no_python(strange):
    plan = fim.fill_in_middle(strange)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Union")[0]


def test_bpe_is_the_library(strange, empty, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    found = bpe.decoded(bpe.encoded(strange, tokenizer), tokenizer).collect()
    assert len(found) == strange.count()
    texts = {}
    for r in strange.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        want = library.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids
        assert ids == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.decoded(bpe.encoded(empty, tokenizer), tokenizer).count() == 0


def test_tree_of_merges():
    """Against merging step by step the leftmost pair of lowest rank."""
    rng = random.Random(5)
    for _ in range(300):
        ranks, made, symbols = {}, [], list(range(4))
        for _ in range(rng.randint(0, 12)):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(4 + len(made))
                symbols.append(made[-1])
        word = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        want = list(word)
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]:
            rank, i = min(pairs)
            want[i : i + 2] = [made[rank]]
        assert bpe.merged(word, ranks, made) == want


def test_decode_of_broken_bytes(spark, tokenizer):
    from tokenizers import Tokenizer

    library, lists = Tokenizer.from_file(tokenizer), [[222], [50256, 222, 50256], [], list(range(300))]
    rows = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(lists)] + [(9, None)], "k long, ids binary")
    found = {r["k"]: r["decoded"] for r in bpe.decoded(rows, tokenizer).collect()}
    assert found == {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {9: None}


def test_error_free_sums():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(1 << 50), 1 << 50, (300, 5)).astype(float) * rng.choice([1.0, 1e-9, 1e6], (300, 1))
    i, j = np.triu_indices(5)
    high, low = whitening.outer_sum(rows, i, j)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(rows[:, a].tolist(), rows[:, b].tolist()))
        size = sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(rows[:, a].tolist(), rows[:, b].tolist()))
        assert abs(Fraction(high[k]) + Fraction(low[k]) - exact) <= size * Fraction(1, 1 << 95)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (200, 20)) @ np.diag(np.linspace(2, 0.2, 20))
    rows = [(k, v.tolist(), "x") for k, v in enumerate(base)] + [(500 + k, base[0].tolist(), "y") for k in range(100)] + [(7, base[3].tolist(), None), (None, base[4].tolist(), None)]
    rows += [(901, None, "x"), (902, [], "x"), (903, [None, *base[0][1:].tolist()], "x"), (904, [float("nan"), *base[0][1:].tolist()], "x"), (905, [float("inf"), *base[0][1:].tolist()], "x"), (906, [1.0, 2.0], "x"), (907, [1e30, *base[0][1:].tolist()], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(5)


def test_whitening(vectors):
    kept = [(r["vec_id"], [int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]]) for r in vectors.where("embedding is not null").collect() if len(r["embedding"]) == 20 and all(c is not None and np.isfinite(c) and c < 1e9 for c in r["embedding"])]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * c - t, n) for c, t in zip(x, s)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(20)] for i in range(20)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    found = whitening.whiten(vectors).collect()
    assert len(found) == len(kept) == 302
    signs = None
    by_id = {}
    for vec_id, x in kept:
        by_id.setdefault(vec_id, []).append(x)
    for r in found:
        (x, *others) = by_id[r["vec_id"]]
        exact = lambda x: sum((n * c - t) ** 2 for c, t in zip(x, s))
        if others and exact(x) != int(r["deviation"]):
            x = others[0]
        assert r["n"] == n and int(r["deviation"]) == exact(x)
        want = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)]) @ axes / np.sqrt(values)
        if signs is None:
            signs = np.sign(want * np.array(r["whitened"]))
        assert np.allclose(np.array(r["whitened"]) * signs, want, rtol=0, atol=1e-9)
        assert np.allclose(r["explained"], values / np.trace(v), rtol=1e-10)
        assert r["identity_error"] < 1e-12
    each = whitening.by_component(whitening.whiten(vectors))
    assert each.count() == 302 * 16 and {r[0] for r in each.select("component").distinct().collect()} == set(range(1, 17))


def test_whitening_without_variance(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).count() == 0
    one = whitening.whiten(vectors.where("vec_id >= 500 and vec_id < 600"))
    assert {(r["n"], int(r["deviation"]), tuple(r["whitened"])) for r in one.collect()} == {(1, 0, ())} and one.count() == 100
    assert whitening.by_component(one).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {len(r["whitened"]) for r in whitening.whiten(line).collect()} == {1}
    wide = spark.createDataFrame([(k, [k * 3e7, 1.0]) for k in (-1, 0, 1)], "vec_id long, embedding array<double>")
    assert {int(r["deviation"]) for r in whitening.whiten(wide).collect()} == {0, (3 * 64 * 30_000_000) ** 2}


def test_digests(spark, tokenizer):
    """The queries' columns on the smallest tables."""
    from tokenizers import Tokenizer

    small = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(tokenizer)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op13_bpe(spark, small).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert dict(queries.op11_whitening(spark, small).dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
