"""Walk-forward models and their nested tuning.

The weeks of one instrument are some hundred rows: they are gathered once, with a
check of their number, and broadcast. Folds, candidates of a search, inner splits
and shuffled columns are rows of Spark tables, each a model of its own to fit, so
that no fold carries a copy of the rows it learns from.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import boosting, regimes
from fathom.operators.backtest import composed, outcomes
from fathom.operators.series import clipped_volatility
from fathom.sources.scratch import written

#: Weeks of an instrument, at most: more than these are no weekly history.
MOST_WEEKS = 50_000
Weeks = dict[str, np.ndarray]


def gathered(rows: DataFrame, columns: list[str], date: str = "date") -> Weeks:
    """The columns of rows as arrays in the order of `date`; an error beyond MOST_WEEKS rows."""
    found = rows.select(date, *dict.fromkeys(c for c in columns if c != date)).limit(MOST_WEEKS + 1).toPandas()
    if len(found) > MOST_WEEKS:
        raise ValueError(f"more than {MOST_WEEKS} rows are no weekly history of one instrument")
    found = found.sort_values(date, kind="stable")
    return {c: found[c].to_numpy() if c == date else found[c].to_numpy(float) for c in found.columns}


def fold_rows(spark: SparkSession, n: int, start: int, step: int, least: int = 1) -> DataFrame:
    """(fold, first, end): the test weeks first..end-1 of each fold of an expanding
    walk-forward over n weeks; a fold trains on all weeks before `first`."""
    count = max(0, -(-(n - start) // step))
    table = spark.range(0, count, 1, max(1, count)).select(F.col("id").alias("fold"), (F.lit(start) + F.col("id") * step).alias("first"))
    return table.withColumn("end", F.least(F.col("first") + step, F.lit(n))).where(F.col("end") - F.col("first") >= least)


def per_row(table: DataFrame, weeks: Weeks, work: Callable[[Weeks, dict, dict], pd.DataFrame], schema: str) -> DataFrame:
    """What work(weeks, row, known) makes of each row of table; the weeks are broadcast, and
    `known` is what the rows of one task share."""
    held = table.sparkSession.sparkContext.broadcast(weeks)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                yield work(held.value, row, known)

    return table.mapInPandas(each, schema)


def filled(weeks: Weeks, columns: list[str]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([weeks[c] for c in columns])) if columns else np.zeros((len(next(iter(weeks.values()))), 0))


def ages(n: int, base: float = 0.995) -> np.ndarray:
    """Weights that fall with the age of a row, 1 on average."""
    w = base ** np.arange(n)[::-1]
    return w / w.mean()


class Regimes(NamedTuple):
    """The rule of regimes.rule_scores() and regimes.adjusted(): weights of columns by group,
    the group of muted weeks, and the sentiment that carries over or doesn't."""

    groups: dict[str, dict[str, float]]
    muted: str
    decayed: tuple[str, ...] = ()
    plain: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.groups, self.muted]

    def seen(self, weeks: Weeks, end: int, train: int, band: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """(number of the regime, probabilities) of the weeks before `end`, by medians and
        ranges of the first `train` weeks."""
        z = {}
        for c in {c for weights in self.groups.values() for c in weights if c in weeks}:
            some = weeks[c][:train][~np.isnan(weeks[c][:train])]
            low, mid, high = np.percentile(some, [25, 50, 75]) if len(some) else (0.0, 0.0, 1.0)
            x = weeks[c][:end]
            z[c] = (np.where(np.isnan(x), mid, x) - mid) / max(high - low, 1e-6)
        scores = np.zeros((end, len(self.names)))
        for g, weights in enumerate(self.groups.values()):
            for c, w in weights.items():
                scores[:, g] += w * z.get(c, 0.0)
        scores[:, -1] = -band * np.abs(scores[:, :-1]).sum(axis=1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        probs = e / e.sum(axis=1, keepdims=True)
        return probs.argmax(axis=1), probs

    def columns(self, weeks: Weeks, regime: np.ndarray, probs: np.ndarray, reset: float, multipliers: list[float]) -> Weeks:
        """The columns that the regimes add: probabilities, switches, and adjusted sentiment."""
        switched = np.append(True, regime[1:] != regime[:-1]).astype(float)
        weight = np.asarray(multipliers)[regime]
        out = {f"regime_prob_{r}": probs[:, k] for k, r in enumerate(self.names)} | {"regime_switched": switched, "regime_sent_mult": weight}
        for some, kept in ((self.decayed, weight * (1 - switched * reset)), (self.plain, weight)):
            out |= {f"{c}_regime_adj": np.nan_to_num(weeks[c][: len(regime)]) * kept for c in some}
        return out


class Choice(NamedTuple):
    """What is tuned: what a switch takes off carried sentiment, the weight of sentiment in
    each regime, and the numbers of the global and the experts' parameters in the grid."""

    reset: float
    multipliers: tuple[float, ...]
    whole: int
    experts: tuple[int, ...]


class Design(NamedTuple):
    """A walk-forward of regime experts: target, features, rule, least rows of an expert, weight of
    the global model, and the grid of parameters."""

    target: str
    features: tuple[str, ...]
    rule: Regimes
    least: int = 40
    weight: float = 0.2
    grid: tuple[dict, ...] = boosting.GRID

    def plain(self) -> Choice:
        """Without tuning: the second parameters of the grid."""
        base = min(1, len(self.grid) - 1)
        return Choice(0.35, tuple(regimes.MULTIPLIERS.get(r, 1.0) for r in self.rule.names), base, (base,) * len(self.rule.names))


def forecast(d: Design, weeks: Weeks, first: int, end: int, choice: Choice, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts, regimes) of weeks first..end-1 by models of the weeks before. Experts see
    weeks of their own regime only, so that one is the same under all choices that
    agree on its own weight and parameters: `known` keeps the models of a task."""
    if ("regimes", first, end) not in known:
        known["regimes", first, end] = d.rule.seen(weeks, end, first)
    regime, probs = known["regimes", first, end]
    more = weeks | d.rule.columns(weeks, regime, probs, choice.reset, choice.multipliers)
    used = sorted({*d.features, *(c for c in more if c.endswith("_regime_adj") or c.startswith("regime_prob_") or c in ("regime_sent_mult", "regime_switched"))})
    x = filled({c: more[c][:end] for c in used}, used)
    y = np.nan_to_num(weeks[d.target][:first])

    def model(key: tuple, rows: np.ndarray, params: int) -> boosting.Trees:
        if key not in known:
            known[key] = boosting.fit(x[:first][rows], y[rows], **d.grid[params])
        return known[key]

    whole = model(("whole", first, choice.reset, choice.multipliers, choice.whole), np.ones(first, bool), choice.whole).predict(x[first:end])
    mixed = np.zeros(end - first)
    for k in range(len(d.rule.names)):
        own = regime[:first] == k
        part = whole
        if own.sum() >= d.least:
            part = model(("expert", k, first, choice.reset, choice.multipliers[k], choice.experts[k]), own, choice.experts[k]).predict(x[first:end])
        mixed += probs[first:end, k] * part
    return d.weight * whole + (1 - d.weight) * mixed, regime[first:end]


class Search(NamedTuple):
    """The grids of a nested search and its inner splits."""

    resets: tuple[float, ...] = (0.20, 0.35, 0.50)
    multipliers: tuple[float, ...] = (0.70, 0.85, 1.00, 1.15)
    splits: int = 3
    size: int = 26

    def ends(self, n: int) -> list[int]:
        """Ends of the training parts within n weeks: evenly spaced, distinct."""
        least = max(78, n // 2)
        return sorted({int(e) for e in np.linspace(least, n - self.size, num=self.splits)}) if n >= least + self.size else []


_SCHEMA = "fold long, first long, reset double, multipliers array<double>, whole int, experts array<int>"
_SETTING = ["reset", "multipliers", "whole", "experts"]


def tuned(folds: DataFrame, weeks: Weeks, d: Design, search: Search = Search()) -> DataFrame:
    """folds (fold, first) with the choice of each: reset, multipliers, whole, experts.

    A staged search: what a switch takes off, then the weight of each regime in turn, then
    the global parameters, then those of the experts, each stage from the choices before it.
    A stage is a table of fold, candidate and inner split; folds share splits with one end, so
    each distinct (split, choice) is scored once, in parallel, and joined back. A
    candidate's score is its mean over splits of the share of right directions, of all weeks or of
    those in the regime that is tuned; the first of the best candidates wins, and where no
    split has such weeks the choice stays. Folds too short for a split keep the plain choice."""
    spark, base, n = folds.sparkSession, d.plain(), len(d.rule.names)
    starts = [(r["fold"], r["first"]) for r in folds.select("fold", "first").collect()]  # a row a fold
    now = spark.createDataFrame([(f, n_, base.reset, list(base.multipliers), base.whole, list(base.experts)) for f, n_ in starts], _SCHEMA)
    splits = spark.createDataFrame([(f, e) for f, n_ in starts for e in search.ends(n_)], "fold long, split long")

    # many splits: the choices of one share a task, and with it the models they have in common
    by = ["split"] if search.splits * len(starts) >= 2 * spark.sparkContext.defaultParallelism else ["split", *_SETTING]

    def replaced(column: str, k: int, value: str):
        return F.transform(column, lambda x, i: F.when(i == k, F.col(value)).otherwise(x))

    def stage(now: DataFrame, values: list, kind: str, regime: int, column: str, change) -> DataFrame:
        grid = F.broadcast(spark.createDataFrame(list(enumerate(values)), f"candidate int, value {kind}"))  # a few rows
        trials = now.crossJoin(grid).withColumn(column, change).join(splits, "fold")
        each = trials.select("split", *_SETTING).distinct()

        def score(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
            first, end = int(row["split"]), min(int(row["split"]) + search.size, len(weeks[d.target]))
            found, at = forecast(d, weeks, first, end, Choice(row["reset"], tuple(row["multipliers"]), int(row["whole"]), tuple(int(e) for e in row["experts"])), known)
            right = (weeks[d.target][first:end] > 0) == (found > 0)
            right = right if regime < 0 else right[at == regime]
            return pd.DataFrame({"split": [first], **{c: [row[c]] for c in _SETTING}, "score": [float(right.mean()) if len(right) else None]})

        scores = per_row(each.repartition(min(200, search.splits * len(starts) * len(values)), *by), weeks, score, "split long, reset double, multipliers array<double>, whole int, experts array<int>, score double")
        means = trials.join(scores, ["split", *_SETTING]).groupBy("fold", "candidate").agg(F.avg("score").alias("score")).where("score is not null")
        best = means.groupBy("fold").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("candidate")).join(grid, "candidate").select("fold", "value")
        return best

    def taken(now: DataFrame, best: DataFrame, column: str, change) -> DataFrame:
        joined = now.join(best, "fold", "left")
        return written(joined.withColumn(column, F.when(F.col("value").isNotNull(), change).otherwise(F.col(column))).select(now.columns), "choices")

    best = stage(now, list(search.resets), "double", -1, "reset", F.col("value"))
    now = taken(now, best, "reset", F.col("value"))
    for k in range(n):
        best = stage(now, list(search.multipliers), "double", k, "multipliers", replaced("multipliers", k, "value"))
        now = taken(now, best, "multipliers", replaced("multipliers", k, "value"))
    params = list(range(len(d.grid)))
    best = stage(now, params, "int", -1, "whole", F.col("value"))
    now = taken(now, best, "whole", F.col("value"))
    # experts are tuned beside the default ones of the others, so their stages don't need each other
    found = [stage(now, params, "int", k, "experts", replaced("experts", k, "value")).select("fold", F.lit(k).alias("k"), "value") for k in range(n)]
    each = found[0]
    for more in found[1:]:
        each = each.union(more)
    by_fold = each.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("found"))
    rest = F.transform("experts", lambda x, i: F.coalesce(F.try_element_at("found", i), F.col("whole")))
    splitless = now.join(splits.select("fold").distinct(), "fold", "left_anti")
    some = now.join(splits.select("fold").distinct(), "fold", "left_semi").join(by_fold, "fold", "left").withColumn("experts", rest).select(now.columns)
    return written(some.unionByName(splitless), "choices")


def regime_walk_forward(rows: DataFrame, d: Design, start: int = 156, step: int = 1, search: Search | None = None, date: str = "date") -> DataFrame:
    """Outcomes of an expanding walk-forward with a model of all weeks ahead and one of each
    regime, mixed by the regimes' probabilities; with `search` each fold's settings are tuned()
    on its training weeks."""
    columns = {*d.features, d.target, *(c for weights in d.rule.groups.values() for c in weights if c in rows.columns), *d.rule.decayed, *d.rule.plain}
    numeric = set(composed(rows, sorted(columns)))
    weeks = gathered(rows, sorted(columns & numeric), date)
    d = d._replace(features=tuple(c for c in d.features if c in numeric))
    folds = fold_rows(rows.sparkSession, len(weeks[date]), start, step)
    plain = d.plain()
    if search:
        folds = folds.join(F.broadcast(tuned(folds, weeks, d, search).drop("first")), "fold")
    else:
        folds = folds.select("*", F.lit(plain.reset).alias("reset"), F.array(*map(F.lit, plain.multipliers)).alias("multipliers"), F.lit(plain.whole).alias("whole"), F.array(*map(F.lit, plain.experts)).alias("experts"))

    def fit(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        a, b = int(row["first"]), int(row["end"])
        found, at = forecast(d, weeks, a, b, Choice(row["reset"], tuple(row["multipliers"]), int(row["whole"]), tuple(int(e) for e in row["experts"])), known)
        return pd.DataFrame({"fold": row["fold"], date: weeks[date][a:b], "y_true": weeks[d.target][a:b], "y_pred": found, "regime": [d.rule.names[k] for k in at]})

    return outcomes(per_row(folds, weeks, fit, f"fold long, {date} date, y_true double, y_pred double, regime string"), date)


#: The learners of boosted_walk_forward() and specialist_walk_forward().
BOOSTED = {"rounds": 1000, "rate": 0.02, "depth": 3, "leaf": 20, "l2": 2.0, "absolute": True, "held": 0.1, "patience": 30}
WHOLE = {"rounds": 300, "rate": 0.05, "depth": 4, "leaf": 15, "l2": 0.1, "absolute": True, "held": 0.1, "patience": 30}
SPECIALIST = {"rounds": 300, "rate": 0.05, "depth": 3, "leaf": 10, "l2": 0.15, "absolute": True, "held": 0.15, "patience": 25}


def scaled(rows: DataFrame, target: str, date: str = "date") -> DataFrame:
    """rows with realized_vol, at least a half, and the target over it as _y, within 10."""
    rows = clipped_volatility(rows.drop("realized_vol"), target, date=date)
    return rows.withColumn("_y", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(target) / F.col("realized_vol"))))


def specialist_walk_forward(rows: DataFrame, target: str, features: list[str], drivers: list[str], scores: dict = regimes.DRIVER_SCORES, start: int = 104, step: int = 13, least: int = 25, weight: float = 0.15, whole: dict = WHOLE, own: dict = SPECIALIST, date: str = "date") -> DataFrame:
    """Outcomes of a walk-forward with a global model and a specialist of each regime that has
    `least` training weeks, all on the target over its volatility, recent weeks (of the
    regime) weighing more. Regimes are those of a hidden Markov model of the training weeks; the
    forecast is mixed by their probabilities and scaled back. n_specialists counts the models."""
    weeks, names = gathered(scaled(rows, target, date), [*features, *drivers, target, "realized_vol", "_y"], date), list(scores)

    def fit(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        a, b = int(row["first"]), int(row["end"])
        x, y, z = filled(weeks, features), np.nan_to_num(weeks["_y"]), filled(weeks, drivers)
        states = regimes.DriverRegimes(z[:a], drivers, scores)
        at = np.array(states.infer(z[:a])[0])
        found, probs = states.infer(z[a:b])
        y_whole = boosting.fit(x[:a], y[:a], ages(a), **whole).predict(x[a:b])
        mixed, n = np.zeros(b - a), 0
        for r in names:
            mine, part = at == r, y_whole
            if mine.sum() >= least:
                n, part = n + 1, boosting.fit(x[:a][mine], y[:a][mine], ages(int(mine.sum())), **own).predict(x[a:b])
            mixed += probs[r] * part
        pred = (weight * y_whole + (1 - weight) * mixed) * weeks["realized_vol"][a:b]
        return pd.DataFrame({"fold": row["fold"], date: weeks[date][a:b], "y_true": weeks[target][a:b], "y_pred": pred, "regime": found, "n_specialists": n})

    folds = fold_rows(rows.sparkSession, len(weeks[date]), start, step, 5)
    return outcomes(per_row(folds, weeks, fit, f"fold long, {date} date, y_true double, y_pred double, regime string, n_specialists int"), date)


def boosted_walk_forward(rows: DataFrame, target: str, features: list[str], start: int = 104, step: int = 13, least: int = 5, params: dict = BOOSTED, date: str = "date") -> DataFrame:
    """(fold, date, y_true, y_pred, n_trees): boosted trees of the weeks ahead of each fold,
    on the target over its volatility, recent weeks weighing more."""
    weeks = gathered(scaled(rows, target, date), [*features, target, "realized_vol", "_y"], date)

    def fit(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        a, b = int(row["first"]), int(row["end"])
        x = filled(weeks, features)
        model = boosting.fit(x[:a], np.nan_to_num(weeks["_y"][:a]), ages(a), **params)
        return pd.DataFrame({"fold": row["fold"], date: weeks[date][a:b], "y_true": weeks[target][a:b], "y_pred": model.predict(x[a:b]) * weeks["realized_vol"][a:b], "n_trees": len(model.trees)})

    folds = fold_rows(rows.sparkSession, len(weeks[date]), start, step, least)
    return per_row(folds, weeks, fit, f"fold long, {date} date, y_true double, y_pred double, n_trees long")


def permutation_importance(rows: DataFrame, target: str, features: list[str], start: int = 104, step: int = 13, least: int = 5, repeats: int = 20, params: dict = BOOSTED, date: str = "date", seed: int = 42) -> DataFrame:
    """(rank, feature, importance): how much more the model of the last fold misses all
    forecast weeks, in units of volatility, when a feature is shuffled among them, on
    average over `repeats`; most important first, ties by name.

    The model is fitted in a task and broadcast; each (feature, repeat) is a row, scored by itself.
    Weeks behind the last fold have no forecast and aren't scored."""
    spark = rows.sparkSession
    weeks = gathered(scaled(rows, target, date), [*features, "_y"], date)
    folds = fold_rows(spark, len(weeks[date]), start, step, least)
    last = folds.orderBy(F.desc("fold")).first()
    schema = "rank int, feature string, importance double"
    if last is None:
        return spark.createDataFrame([], schema)
    end = int(last["end"])

    def fit(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        a = int(row["first"])
        return pd.DataFrame({"model": [pickle.dumps(boosting.fit(filled(weeks, features)[:a], np.nan_to_num(weeks["_y"][:a]), ages(a), **params))]})

    model = spark.sparkContext.broadcast(per_row(folds.where(F.col("fold") == last["fold"]), weeks, fit, "model binary").first()["model"])

    def score(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        x, y, trees = filled(weeks, features)[start:end], np.nan_to_num(weeks["_y"][start:end]), pickle.loads(model.value)
        j = int(row["j"])
        before = np.abs(trees.predict(x) - y).mean()
        x[:, j] = np.random.default_rng([seed, j, int(row["k"])]).permutation(x[:, j])
        return pd.DataFrame({"feature": [features[j]], "k": [int(row["k"])], "more": [np.abs(trees.predict(x) - y).mean() - before]})

    grid = spark.range(0, len(features) * repeats, 1, max(1, min(len(features) * repeats, 2 * spark.sparkContext.defaultParallelism))).select((F.col("id") / repeats).cast("int").alias("j"), (F.col("id") % repeats).alias("k"))
    found = per_row(grid, weeks, score, "feature string, k int, more double").groupBy("feature").agg(F.avg("more").alias("importance"))
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))  # a row a feature
    return found.select(rank.cast("int").alias("rank"), "feature", "importance")


def ridge_walk_forward(rows: DataFrame, target: str, features: list[str], start: int = 104, step: int = 13, least: int = 5, ridge: float = 1.0, date: str = "date") -> DataFrame:
    """(fold, date, y_true, y_pred): each fold's forecasts by a linear model of the weeks ahead."""
    weeks = gathered(rows, [*features, target], date)

    def fit(weeks: Weeks, row: dict, known: dict) -> pd.DataFrame:
        a, b = int(row["first"]), int(row["end"])
        x, y = filled(weeks, features)[:b], weeks[target][:b]
        mean, std = x[:a].mean(axis=0), x[:a].std(axis=0) + 1e-9
        z = np.column_stack([(x - mean) / std, np.ones(b)])
        known = ~np.isnan(y[:a])
        w = np.linalg.solve(z[:a][known].T @ z[:a][known] + ridge * np.eye(z.shape[1]), z[:a][known].T @ y[:a][known])
        return pd.DataFrame({"fold": row["fold"], date: weeks[date][a:b], "y_true": y[a:b], "y_pred": z[a:b] @ w})

    folds = fold_rows(rows.sparkSession, len(weeks[date]), start, step, least)
    return per_row(folds, weeks, fit, f"fold long, {date} date, y_true double, y_pred double")
