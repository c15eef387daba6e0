"""Hidden Markov models: blocks of time against the sum over all paths, and one block."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import markov as M
from fathom.operators import regimes as R


def model(seed=0, states=3, d=2):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    cov = np.stack([(lambda a: a @ a.T + 0.5 * np.eye(d))(rng.normal(size=(d, d))) for _ in range(states)])
    return M.States(norm(rng.random(states)), norm(rng.random((states, states))), rng.normal(0, 2, (states, d)), cov)


def brute(m, x):
    """(posteriors, expected moves, log-likelihood, best path) by all paths."""
    density = lambda v, k: math.exp(-0.5 * (v - m.mean[k]) @ np.linalg.inv(m.cov[k]) @ (v - m.mean[k])) / math.sqrt((2 * math.pi) ** len(v) * np.linalg.det(m.cov[k]))
    s, n = len(m.first), len(x)
    post, pairs, total, best = np.zeros((n, s)), np.zeros((s, s)), 0.0, (0.0, None)
    for path in itertools.product(range(s), repeat=n):
        p = m.first[path[0]] * density(x[0], path[0])
        for t in range(1, n):
            p *= m.move[path[t - 1], path[t]] * density(x[t], path[t])
        total += p
        best = max(best, (p, path))
        for t, k in enumerate(path):
            post[t, k] += p
        for a, b in itertools.pairwise(path):
            pairs[a, b] += p
    return post / total, pairs / total, math.log(total), np.array(best[1])


def test_against_all_paths():
    m, x = model(), np.random.default_rng(1).normal(0, 2, (7, 2))
    post, pairs, seen, path = brute(m, x)
    whole, scale = M.product(m, x, True)
    assert math.isclose(math.log((m.first @ whole).sum()) + scale, seen, rel_tol=1e-12)
    found, sums = M.smoothed(m, x, True, m.first, np.ones(3))
    assert np.allclose(found, post) and np.allclose(sums.pairs, pairs) and np.allclose(sums.first, post[0])
    assert (M.decoded(m, x)[0] == path).all()
    # two blocks: matrices multiply, and sums add up
    a, b = x[:3], x[3:]
    first, second = M.product(m, a, True), M.product(m, b, False)
    assert np.allclose(first[0] @ second[0] * math.exp(first[1] + second[1] - scale), whole)
    before = m.first @ first[0]
    one, s1 = M.smoothed(m, a, True, m.first, second[0] @ np.ones(3))
    two, s2 = M.smoothed(m, b, False, before / before.sum(), np.ones(3))
    assert np.allclose(np.vstack([one, two]), post) and np.allclose(s1.pairs + s2.pairs, pairs) and np.allclose(s1.xx + s2.xx, sums.xx)


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = np.random.default_rng(5), []
    for name, n in (("a", 300), ("b", 90), ("c", 4)):
        truth = (np.arange(n) // 30) % 3
        rows += [(name, dt.date(2015, 1, 2) + dt.timedelta(7 * k), float(rng.normal()), float(rng.normal(4.0 * truth[k], 0.5))) for k in range(n)]
    rows += [("a", dt.date(2030, 1, 1), None, 1.0), (None, dt.date(2030, 1, 1), 1.0, 1.0)]
    return spark.createDataFrame(rows, "series string, date date, x double, y double")


def test_blocks_find_what_one_block_finds(spark, series):
    one = {(r["series"], r["date"]): r for r in R.markov_regime(series, ["x", "y"]).collect()}
    many = {(r["series"], r["date"]): r for r in R.markov_regime(series, ["x", "y"], block=50).collect()}
    assert len(one) == len(many) == series.count() and M.blocks(series.dropna(), ["x", "y"], block=50).where("series = 'a'").count() > 2
    for k, r in one.items():
        assert r["hmm_regime"] == many[k]["hmm_regime"]
        assert all(math.isclose(r[f"hmm_prob_{j}"], many[k][f"hmm_prob_{j}"], abs_tol=1e-4) for j in range(3))
        assert (r["hmm_regime"] is None) == (k[0] in ("c", None) or k[1].year == 2030)
    data = series.where("series = 'a'").dropna().orderBy("date").toPandas()
    path, post, seen = R.markov.hidden_markov(data[["x", "y"]].to_numpy())
    assert [one["a", day]["hmm_regime"] for day in data["date"]] == path.tolist() and all(b >= a - 1e-6 for a, b in itertools.pairwise(seen))


def test_rounds_over_blocks_have_the_likelihoods_of_one_block(spark, series):
    data = series.where("series = 'a'").dropna()
    fits = M.fit(M.blocks(data, ["x", "y"], block=40), M.Settings(3), 2)
    found, seen = M.fitted(data.orderBy("date").toPandas()[["x", "y"]].to_numpy(), M.Settings(3))
    assert np.allclose(fits.seen["a"], seen) and np.allclose(fits.models["a"].mean, found.mean) and np.allclose(fits.models["a"].move, found.move)


def test_an_empty_table_has_no_states(spark, series):
    assert R.markov_regime(series.limit(0), ["x", "y"]).count() == 0
    assert {r["hmm_regime"] for r in R.markov_regime(series.where("series = 'c'"), ["x", "y"]).collect()} == {None}


def test_driver_regimes_of_several_series(spark):
    rng, rows = np.random.default_rng(3), []
    centre = np.eye(4) * 5
    for name in ("s", "t"):
        truth = np.repeat([0, 1, 2, 3, 0, 2], 50)
        rows += [(name, dt.date(2015, 1, 2) + dt.timedelta(k), *(centre[t] + rng.normal(0, 0.3, 4)).tolist(), int(t)) for k, t in enumerate(truth)]
    rows += [("few", dt.date(2015, 1, 2), 1.0, None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "series string, date date, a double, b double, c double, d double, truth int")
    scores = {n: ((c, 1, False),) for n, c in zip(R.REGIMES, "abcd", strict=True)}
    models = R.driver_models(df, list("abcd"), scores, block=70)
    found = R.driver_regime(df, list("abcd"), scores, models=models).join(df.select("series", "date", "truth"), ["series", "date"]).collect()
    assert len(found) == 601 and np.mean([r["regime"] == R.REGIMES[r["truth"]] for r in found if r["series"] != "few"]) > 0.98
    assert all(r["regime"] is None for r in found if r["series"] == "few")
    assert all(math.isclose(sum(r[f"regime_prob_{n}"] for n in R.REGIMES), 1) for r in found if r["series"] != "few")
    report = {(r["series"], r["regime"]): r for r in R.state_report(models, spark).collect()}
    assert set(report) == {(s, n) for s in "st" for n in R.REGIMES}
    for (_, name), r in report.items():
        assert r["decay_weeks"] == R.DECAY_WEEKS[name] and math.isclose(sum(r["moves"].values()), 1, abs_tol=0.01) and r["moves"][name] > 0.9
        assert abs(r["means"]["abcd"[R.REGIMES.index(name)]] - 5) < 0.2
    assert df.where(F.col("series") == "few").count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
@pytest.mark.parametrize("begins", [True, False])
def test_lanes_side_by_side_find_what_a_row_at_a_time_finds(n, begins):
    """A block takes as many steps as the root of its rows, whose results are those of one row after another."""
    x = np.random.default_rng(n).normal(size=(n, 1)) * 2
    model = M.States(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.array([[[1.0]], [[2.0]]]))
    assert M._lanes(np.ones((n, 2, 2)), np.eye(2)).shape[1] <= 2 * np.sqrt(n)
    b, top = M.densities(model, x)
    each = [np.diag(b[t]) if begins and t == 0 else model.move * b[t] for t in range(n)]
    whole, scale = np.eye(2), top.sum()
    for one in each:
        whole = whole @ one
        scale += np.log(whole.max())
        whole = whole / whole.max()
    got, of = M.product(model, x, begins)
    assert np.allclose(got, whole) and np.isclose(of, scale)
    before, behind = np.array([0.4, 0.6]), np.array([0.5, 1.5])
    ahead, after = [before], [behind]
    for one, back in zip(each, each[:0:-1] + [None]):
        ahead.append(ahead[-1] @ one / (ahead[-1] @ one).sum())
        after.append(after[-1] if back is None else back @ after[-1] / (back @ after[-1]).sum())
    want = np.array(ahead[1:]) * np.array(after[:n][::-1])
    assert np.allclose(M.smoothed(model, x, begins, before, behind)[0], want / want.sum(axis=1, keepdims=True))
    best, logs = np.log(before), [np.log(one + 1e-300) for one in each]
    for one in logs:
        best = (best[:, None] + one).max(axis=0)
    end = int(best.argmax())
    path = M.most_likely(model, x, begins, np.log(before), end)
    score = max(np.log(before)[s] + logs[0][s, path[0]] for s in range(2)) + sum(logs[t][path[t - 1], path[t]] for t in range(1, n))
    assert path[-1] == end and np.isclose(score, best[end])
