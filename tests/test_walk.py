"""Walk-forward models against plain loops."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import boosting, walk
from fathom.operators import regimes as R

GRID = ({"rounds": 10, "depth": 2, "rate": 0.2, "leaf": 8}, {"rounds": 15, "depth": 2, "rate": 0.3, "leaf": 6}, {"rounds": 20, "depth": 3, "rate": 0.3, "leaf": 5})
RULE = walk.Regimes({"up": {"a": 1.0}, "down": {"b": -1.0}}, "calm", ("a",), ("b",))
DESIGN = walk.Design("y", ("a", "b"), RULE, least=20, grid=GRID)


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(9), []
    for k in range(200):
        a, b = rng.normal(size=2)
        out.append((dt.date(2015, 1, 2) + dt.timedelta(7 * k), float(a), None if k % 17 == 0 else float(b), float(2 * np.sign(a) + rng.normal(0, 1.0))))
    return spark.createDataFrame(out, "date date, a double, b double, y double")


@pytest.fixture(scope="module")
def weeks(rows):
    return walk.gathered(rows, ["a", "b", "y"])


def test_gathered_checks_the_number_of_rows(spark):
    with pytest.raises(ValueError):
        walk.gathered(spark.range(walk.MOST_WEEKS + 1).withColumn("date", F.col("id")), ["id"])


def test_folds_are_rows(spark):
    assert [tuple(r) for r in walk.fold_rows(spark, 20, 10, 4, 3).collect()] == [(0, 10, 14), (1, 14, 18)]
    assert [tuple(r) for r in walk.fold_rows(spark, 12, 10, 1).collect()] == [(0, 10, 11), (1, 11, 12)]
    assert walk.fold_rows(spark, 5, 10, 1).count() == 0


def test_composed_features(spark):
    """Numeric columns of the base and those that regimes add, sorted, each once."""
    from fathom.operators.backtest import composed

    df = spark.sql("SELECT 1 AS b, 2.0D AS a, 'x' AS text, 3 AS a_regime_adj, 0.5D AS regime_prob_up, 1 AS regime_switched, 1.0D AS regime_sent_mult, 'up' AS regime, 9 AS other")
    assert composed(df, ["b", "a", "text", "none", "b"]) == ["a", "a_regime_adj", "b", "regime_prob_up", "regime_sent_mult", "regime_switched"]


def test_the_rule_is_that_of_the_columns(spark, rows, weeks):
    """Regimes, probabilities and adjusted sentiment as regimes.rule_scores() and adjusted() have them."""
    regime, probs = RULE.seen(weeks, 200, 150)
    train = rows.orderBy("date").limit(150)
    want = R.adjusted(R.rule_scores(rows, RULE.groups, RULE.muted, train), ["a"], ["b"], multipliers={"up": 1.1, "down": 0.6, "calm": 0.5}).orderBy("date").collect()
    more = RULE.columns(weeks, regime, probs, 0.35, [1.1, 0.6, 0.5])
    for k, r in enumerate(want):
        assert RULE.names[regime[k]] == r["regime"]
        assert all(math.isclose(probs[k, j], r[f"regime_prob_{n}"], abs_tol=1e-9) for j, n in enumerate(RULE.names))
        assert all(math.isclose(more[c][k], r[c], abs_tol=1e-9) for c in ("a_regime_adj", "b_regime_adj", "regime_switched", "regime_sent_mult"))


def one_forecast(weeks, first, end, reset, multipliers, whole, experts):
    """A fold by hand: models of all training weeks and of each regime, mixed."""
    regime, probs = RULE.seen(weeks, end, first)
    more = {k: v[:end] for k, v in weeks.items() if k != "date"} | RULE.columns(weeks, regime, probs, reset, list(multipliers))
    x = np.nan_to_num(np.column_stack([more[c] for c in sorted(c for c in more if c != "y")]))
    y = weeks["y"][:first]
    g = boosting.fit(x[:first], y, **GRID[whole]).predict(x[first:])
    out = 0.2 * g
    for k in range(3):
        own = regime[:first] == k
        part = boosting.fit(x[:first][own], y[own], **GRID[experts[k]]).predict(x[first:]) if own.sum() >= 20 else g
        out = out + 0.8 * probs[first:, k] * part
    return out, regime[first:]


def test_walk_forward_at_every_week(rows, weeks):
    found = {r["date"]: r for r in walk.regime_walk_forward(rows, DESIGN, start=170).collect()}
    assert len(found) == 30
    plain = DESIGN.plain()
    for first in (170, 185, 199):
        want, regime = one_forecast(weeks, first, first + 1, plain.reset, plain.multipliers, plain.whole, plain.experts)
        r = found[weeks["date"][first]]
        assert math.isclose(r["y_pred"], want[0], abs_tol=1e-9) and r["regime"] == RULE.names[regime[0]] and math.isclose(r["y_true"], weeks["y"][first])
    late = rows.withColumn("y", F.when(F.col("date") >= weeks["date"][190], -F.col("y")).otherwise(F.col("y")))
    again = {r["date"]: r for r in walk.regime_walk_forward(late, DESIGN, start=170).collect()}
    assert all(found[d]["y_pred"] == again[d]["y_pred"] for d in found if d < weeks["date"][190])


def by_hand(weeks, n, search):
    """The nested search as a loop: the first of the best candidates of each stage."""
    plain = DESIGN.plain()
    reset, multipliers, whole, experts = plain.reset, list(plain.multipliers), plain.whole, list(plain.experts)
    if not search.ends(n):
        return reset, multipliers, whole, experts

    def score(reset, multipliers, whole, experts, regime=None):
        found = []
        for e in search.ends(n):
            pred, at = one_forecast(weeks, e, min(e + search.size, 200), reset, multipliers, whole, experts)
            right = (weeks["y"][e : e + search.size] > 0) == (pred > 0)
            right = right if regime is None else right[at == regime]
            found += [right.mean()] if len(right) else []
        return np.mean(found) if found else -np.inf

    best = -np.inf
    for v in search.resets:
        s = score(v, multipliers, whole, experts)
        if s > best:
            best, reset = s, v
    for k in range(3):
        best, chosen = -np.inf, multipliers[k]
        for v in search.multipliers:
            trial = multipliers[:k] + [v] + multipliers[k + 1 :]
            s = score(reset, trial, whole, experts, k)
            if s > best:
                best, chosen = s, v
        multipliers[k] = chosen
    best, chosen = -np.inf, whole
    for p in range(3):
        s = score(reset, multipliers, p, experts)
        if s > best:
            best, chosen = s, p
    whole, default, chosen_experts = chosen, list(experts), []
    for k in range(3):
        best, mine = -np.inf, whole
        for p in range(3):
            s = score(reset, multipliers, whole, default[:k] + [p] + default[k + 1 :], k)
            if s > best:
                best, mine = s, p
        chosen_experts.append(mine)
    return reset, multipliers, whole, chosen_experts


def test_nested_tuning_on_three_folds(spark, rows, weeks):
    search = walk.Search(resets=(0.2, 0.5), multipliers=(0.7, 1.15))
    folds = spark.createDataFrame([(0, 90), (1, 150), (2, 151)], "fold long, first long")
    found = {r["fold"]: r for r in walk.tuned(folds, weeks, DESIGN, search).collect()}
    assert len(found) == 3 and search.ends(90) == []
    for fold, n in ((0, 90), (1, 150), (2, 151)):
        r = found[fold]
        assert (r["reset"], r["multipliers"], r["whole"], r["experts"]) == by_hand(weeks, n, search)


def test_walk_forward_takes_what_is_tuned(rows, weeks):
    search = walk.Search(resets=(0.2,), multipliers=(0.7,))
    found = {r["date"]: r for r in walk.regime_walk_forward(rows, DESIGN, start=198, search=search).collect()}
    for first in (198, 199):
        choice = by_hand(weeks, first, search)
        assert math.isclose(found[weeks["date"][first]]["y_pred"], one_forecast(weeks, first, first + 1, *choice)[0][0], abs_tol=1e-9)


def test_specialists_by_hand(rows):
    """One fold: scaled target, ages within each regime, learners of their own, scaled back."""
    scores = {"up": (("a", 1, False),), "down": (("a", -1, False),), "wide": (("b", 1, True),), "rest": ()}
    whole, own = walk.WHOLE | {"rounds": 12}, walk.SPECIALIST | {"rounds": 9}
    found = [r for r in walk.specialist_walk_forward(rows, "y", ["a", "b"], ["a", "b"], scores, whole=whole, own=own).collect()]
    assert len(found) == 200 - 104 - 5 + 5 and {r["regime"] for r in found} <= set(scores)
    data = walk.scaled(rows, "y").orderBy("date").toPandas()
    ret = data["y"]
    vol = ret.rolling(8, min_periods=4).std().clip(lower=0.5).bfill().to_numpy()
    assert np.allclose(vol, data["realized_vol"])
    y, x, a, b = np.clip(ret / vol, -10, 10).to_numpy(), data[["a", "b"]].fillna(0).to_numpy(), 117, 130
    states = R.DriverRegimes(x[:a], ["a", "b"], scores)
    at, (regime, probs) = np.array(states.infer(x[:a])[0]), states.infer(x[a:b])
    age = lambda n: 0.995 ** np.arange(n)[::-1] / (0.995 ** np.arange(n)).mean()
    g = boosting.fit(x[:a], y[:a], age(a), **whole).predict(x[a:b])
    mixed = sum(probs[n] * (boosting.fit(x[:a][at == n], y[:a][at == n], age((at == n).sum()), **own).predict(x[a:b]) if (at == n).sum() >= 25 else g) for n in scores)
    want = (0.15 * g + 0.85 * mixed) * vol[a:b]
    mine = sorted((r for r in found if r["fold"] == 1), key=lambda r: r["date"])
    assert np.allclose([r["y_pred"] for r in mine], want) and [r["regime"] for r in mine] == regime
    assert {r["n_specialists"] for r in mine} == {sum((at == n).sum() >= 25 for n in scores)}


def test_boosted_and_importance_by_hand(rows):
    params = walk.BOOSTED | {"rounds": 40, "rate": 0.1}
    found = walk.boosted_walk_forward(rows, "y", ["a", "b"], params=params).collect()
    assert len(found) == 96 and sum((r["y_true"] > 0) == (r["y_pred"] > 0) for r in found) > 80
    ranks = walk.permutation_importance(rows, "y", ["b", "a"], repeats=3, params=params).orderBy("rank").collect()
    data = walk.scaled(rows, "y").orderBy("date").toPandas()
    x, y = data[["b", "a"]].fillna(0).to_numpy(), data["_y"].to_numpy()
    first, end = 104 + 13 * 7, 200  # the last fold has five weeks
    model = boosting.fit(x[:first], y[:first], walk.ages(first), **params)
    base = np.abs(model.predict(x[104:end]) - y[104:end]).mean()
    for j, name in enumerate(("b", "a")):
        more = []
        for k in range(3):
            mixed = x[104:end].copy()
            mixed[:, j] = np.random.default_rng([42, j, k]).permutation(mixed[:, j])
            more.append(np.abs(model.predict(mixed) - y[104:end]).mean() - base)
        assert math.isclose(next(r["importance"] for r in ranks if r["feature"] == name), np.mean(more), abs_tol=1e-9)
    assert [r["feature"] for r in ranks] == ["a", "b"] and all(a["importance"] >= b["importance"] for a, b in itertools.pairwise(ranks))
    # four weeks behind the last whole fold have no forecast
    short = walk.permutation_importance(rows.orderBy("date").limit(199), "y", ["b", "a"], repeats=1, params=params).count()
    assert short == 2 and walk.permutation_importance(rows.limit(50), "y", ["a"], repeats=1, params=params).count() == 0
