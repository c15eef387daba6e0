"""Gaussian hidden Markov models of many series, long ones in blocks of time.

What a block of rows does to the probabilities of the states is one matrix, and
matrices multiply in any grouping. So each round of expectation maximisation has
every block make its matrix in a task of its own; the matrices of a series, one
for thousands of rows, are scanned for the vectors at the blocks' ends; and the
blocks add up their sums from there, which Spark aggregates by series. The most
likely path is found likewise, with maxima for sums. A series of one block is
fitted to the end where it lies, by the same functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.scratch import written

#: Rows of a block, about: numpy takes as many steps as the root of it.
BLOCK = 32_768


class States(NamedTuple):
    """Shares at the start, moves, means and covariances."""

    first: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def ordered(self) -> States:
        """Numbered by the mean of the last column."""
        order = np.argsort(self.mean[:, -1], kind="stable")
        return States(self.first[order], self.move[np.ix_(order, order)], self.mean[order], self.cov[order])


def densities(model: States, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities of each row over the largest one of it, and that one's logarithm."""
    out = np.empty((len(x), len(model.mean)))
    for k in range(len(model.mean)):
        low = np.linalg.cholesky(model.cov[k])
        y = np.linalg.solve(low, (x - model.mean[k]).T)
        out[:, k] = -0.5 * (y * y).sum(axis=0) - np.log(np.diag(low)).sum() - x.shape[1] / 2 * math.log(2 * math.pi)
    top = out.max(axis=1)
    return np.exp(out - top[:, None]), top


def _lanes(each: np.ndarray, still: np.ndarray) -> np.ndarray:
    """The matrices of a block's rows as (lane, step, ...): runs of rows that numpy works through
    side by side. The last lane ends with matrices that leave things as they are."""
    lanes = max(1, math.isqrt(len(each)))
    steps = -(-len(each) // lanes)
    return np.concatenate([each, np.broadcast_to(still, (lanes * steps - len(each), *still.shape))]).reshape(lanes, steps, *still.shape)


def _moves(model: States, b: np.ndarray, begins: bool) -> np.ndarray:
    """What each row does to the probabilities of the states, as (lane, step, from, to)."""
    each = model.move[None] * b[:, None, :]
    if begins:
        each[0] = np.diag(b[0])
    return _lanes(each, np.eye(len(model.mean)))


def _wholes(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the product of each lane over its largest entry, that one's logarithm)."""
    whole, scale = np.broadcast_to(np.eye(moves.shape[-1]), moves[:, 0].shape), np.zeros(len(moves))
    for t in range(moves.shape[1]):
        whole = whole @ moves[:, t]
        size = whole.max(axis=(1, 2))
        whole = whole / size[:, None, None]
        scale += np.log(size)
    return whole, scale


def product(model: States, x: np.ndarray, begins: bool) -> tuple[np.ndarray, float]:
    """(matrix, logarithm of its scale): states before the block by states at its end. The
    first block of a series starts from the shares, without a move."""
    b, top = densities(model, x)
    lanes, scales = _wholes(_moves(model, b, begins))
    whole, scale = np.eye(len(model.mean)), float(top.sum()) + float(scales.sum())
    for one in lanes:
        whole = whole @ one
        size = whole.max()
        whole = whole / size
        scale += math.log(size)
    return whole, scale


def _best_moves(model: States, b: np.ndarray, begins: bool) -> np.ndarray:
    """_moves() for log-likelihoods of paths."""
    apart = np.where(np.eye(b.shape[1]) > 0, 0.0, -np.inf)
    each = np.log(model.move + 1e-300)[None] + b[:, None, :]
    if begins:
        each[0] = apart + b[0]
    return _lanes(each, apart)


def _best_wholes(moves: np.ndarray) -> np.ndarray:
    whole = moves[:, 0]
    for t in range(1, moves.shape[1]):
        whole = (whole[:, :, :, None] + moves[:, t, None]).max(axis=2)
    return whole


def best_product(model: States, x: np.ndarray, begins: bool) -> np.ndarray:
    """Largest log-likelihood of the paths between a state before the block and one at its end."""
    whole = None
    for one in _best_wholes(_best_moves(model, np.log(densities(model, x)[0] + 1e-300), begins)):
        whole = one if whole is None else (whole[:, :, None] + one[None]).max(axis=1)
    return whole


class Sums(NamedTuple):
    """What a maximisation needs of a block: weights of the states, sums of x and of the
    products of x less `about`, moves, probabilities of the first row."""

    weight: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self])

    @classmethod
    def of(cls, flat: np.ndarray, states: int, d: int) -> Sums:
        sizes = np.cumsum([states, states * d, states * d * d, states * states])
        w, x, xx, pairs, first = np.split(np.asarray(flat, float), sizes)
        return cls(w, x.reshape(states, d), xx.reshape(states, d, d), pairs.reshape(states, states), first)


def moments(x: np.ndarray, post: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    apart = x[:, None, :] - about[None]
    return post.sum(axis=0), post.T @ x, np.einsum("tk,tki,tkj->kij", post, apart, apart)


def smoothed(model: States, x: np.ndarray, begins: bool, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, Sums]:
    """(posteriors of the rows, sums) of a block from the vectors at its ends."""
    b, _ = densities(model, x)
    n, states = b.shape
    moves = _moves(model, b, begins)
    lanes, steps = moves.shape[:2]
    wholes, _ = _wholes(moves)
    fore, aft = np.empty((lanes, states)), np.empty((lanes, states))
    fore[0], aft[-1] = before / before.sum(), behind / behind.sum()
    for k in range(1, lanes):
        now = fore[k - 1] @ wholes[k - 1]
        fore[k] = now / now.sum()
    for k in range(lanes - 1, 0, -1):
        now = wholes[k] @ aft[k]
        aft[k - 1] = now / now.sum()
    ahead, after = np.empty((lanes, steps, states)), np.empty((lanes, steps, states))
    now = fore
    for t in range(steps):
        now = (now[:, None, :] @ moves[:, t])[:, 0]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[:, t] = now
    now = aft
    for t in range(steps - 1, -1, -1):
        after[:, t] = now
        now = (moves[:, t] @ now[:, :, None])[:, :, 0]
        now = now / now.sum(axis=1, keepdims=True)
    ahead, after = ahead.reshape(-1, states)[:n], after.reshape(-1, states)[:n]
    post = ahead * after
    post /= post.sum(axis=1, keepdims=True)
    last = np.vstack([before[None], ahead[:-1]])[begins:]
    pairs = last[:, :, None] * model.move[None] * (b * after)[begins:, None, :]
    pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, Sums(*moments(x, post, model.mean), pairs, post[0] if begins else np.zeros(states))


def most_likely(model: States, x: np.ndarray, begins: bool, before: np.ndarray, end: int) -> np.ndarray:
    """The states of a block that ends in `end`, from the best log-likelihoods before it."""
    moves = _best_moves(model, np.log(densities(model, x)[0] + 1e-300), begins)
    lanes, steps = moves.shape[:2]
    wholes, best, ends = _best_wholes(moves), np.empty((lanes, len(before))), np.empty(lanes, int)
    best[0], ends[-1] = before, end
    for k in range(1, lanes):
        now = (best[k - 1][:, None] + wholes[k - 1]).max(axis=0)
        best[k] = now - now.max()
    for k in range(lanes - 1, 0, -1):
        ends[k - 1] = (best[k] + wholes[k][:, ends[k]]).argmax()
    now, back = best, np.empty((lanes, steps, len(before)), int)
    for t in range(steps):
        step = now[:, :, None] + moves[:, t]
        back[:, t], now = step.argmax(axis=1), step.max(axis=1)
    out, at = np.empty((lanes, steps), int), ends
    for t in range(steps - 1, -1, -1):
        out[:, t] = at
        at = back[np.arange(lanes), t, at]
    return out.ravel()[: len(x)]


def maximised(model: States, sums: Sums, floor: float, diagonal: bool) -> States:
    states, d = model.mean.shape
    shape = np.eye(d) if diagonal else np.ones((d, d))
    weight = sums.weight + 1e-12
    mean = sums.x / weight[:, None]
    apart = mean - model.mean
    cov = sums.xx / weight[:, None, None] - np.einsum("ki,kj->kij", apart, apart) * (sums.weight / weight)[:, None, None]
    pairs = sums.pairs + 1e-12
    return States(sums.first / sums.first.sum(), pairs / pairs.sum(axis=1, keepdims=True), mean, cov * shape + floor * np.eye(d))


def started(parts: Sums, states: int, floor: float, diagonal: bool) -> States:
    """The first model: equal shares and moves of 0.9 to itself, the mean of each part of
    the rows, and the covariance of all. parts: sums over parts, about 0."""
    d = parts.x.shape[1]
    n = parts.weight.sum()
    mean = parts.x.sum(axis=0) / n
    cov = (parts.xx.sum(axis=0) - n * np.outer(mean, mean)) / max(n - 1, 1)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    each = np.where(parts.weight[:, None] > 0, parts.x / np.maximum(parts.weight, 1)[:, None], mean)
    cov = cov * (np.eye(d) if diagonal else 1) + floor * np.eye(d)
    return States(np.full(states, 1 / states), move, each, np.stack([cov] * states))


def part_sums(x: np.ndarray, cuts: np.ndarray, states: int) -> Sums:
    """Sums over the parts of the rows that `cuts` of the last column tell apart."""
    post = np.eye(states)[np.searchsorted(cuts, x[:, -1], "left")]
    return Sums(*moments(x, post, np.zeros((states, x.shape[1]))), np.zeros((states, states)), np.zeros(states))


def cuts_of(x: np.ndarray, states: int) -> np.ndarray:
    return np.quantile(x[:, -1], np.arange(1, states) / states, method="inverted_cdf")


class Settings(NamedTuple):
    states: int
    rounds: int = 200
    tolerance: float = 1e-4
    floor: float = 1e-3
    diagonal: bool = False


def fitted(x: np.ndarray, s: Settings) -> tuple[States, list[float]]:
    """(model, log-likelihood after each round) of a series of one block."""
    model = started(part_sums(x, cuts_of(x, s.states), s.states), s.states, s.floor, s.diagonal)
    seen: list[float] = []
    for _ in range(s.rounds):
        whole, scale = product(model, x, True)
        seen.append(math.log(float((model.first @ whole).sum())) + scale)
        if len(seen) > 1 and seen[-1] - seen[-2] < s.tolerance:
            break
        model = maximised(model, smoothed(model, x, True, model.first, np.ones(s.states))[1], s.floor, s.diagonal)
    return model.ordered(), seen


def decoded(model: States, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most likely path, posteriors) of a series of one block."""
    before = np.log(model.first + 1e-300)
    end = int((before[:, None] + best_product(model, x, True)).max(axis=0).argmax())
    return most_likely(model, x, True, before, end), smoothed(model, x, True, model.first, np.ones(len(before)))[0]


def hidden_markov(x: np.ndarray, states: int = 3) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(most likely path, posteriors, log-likelihood after each round) of one series."""
    model, seen = fitted(x, Settings(states))
    return *decoded(model, x), seen


def _each(batch: pd.DataFrame) -> Iterator[SimpleNamespace]:
    return (SimpleNamespace(**row) for row in batch.to_dict("records"))


def _matrix(row) -> np.ndarray:
    return np.asarray(row.x, float).reshape(row.n, -1)


def blocks(rows: DataFrame, columns: list[str], date: str = "date", key: str = "series", block: int = BLOCK) -> DataFrame:
    """(key, block, n, days, x): runs of rows of one series, in order; block counts from
    0 in each series. Rows are dealt by ranges of (key, date), so that a long series is many
    tasks, and no window runs over a series; (key, date) tells rows apart."""
    flat = rows.select(F.col(key).cast("string").alias(key), F.col(date).alias("day"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    parts = max(1, math.ceil(flat.count() / block))
    dealt = flat.repartitionByRange(parts, key, "day").sortWithinPartitions(key, "day")
    kind = rows.schema[date].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            for name, some in batch.groupby(key, sort=False):
                days, xs = found.setdefault(name, ([], []))
                days += some["day"].tolist()
                xs += some["x"].tolist()
        for name, (days, xs) in found.items():
            yield pd.DataFrame({key: [name], "part": [part], "n": [len(days)], "days": [days], "x": [np.concatenate(xs).tolist()]})

    packed = written(dealt.mapInPandas(pack, f"{key} string, part int, n int, days array<{kind}>, x array<double>"), "blocks")
    # a row a block from here on
    order = packed.groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return written(packed.join(order, key).select(key, (F.array_position("parts", F.col("part")) - 1).cast("int").alias("block"), F.size("parts").alias("n_blocks"), "n", "days", "x"), "blocks")


class Fits(NamedTuple):
    """The models of the series, held by the driver: some numbers for each series."""

    models: dict[str, States]
    seen: dict[str, list[float]]


def fit(packed: DataFrame, s: Settings, d: int, key: str = "series") -> Fits:
    """A model for each series of blocks()."""
    size = s.states + s.states * s.states + s.states * d + s.states * d * d

    def flat(m: States) -> list[float]:
        return np.concatenate([a.ravel() for a in m]).tolist()

    def model(v) -> States:
        first, move, mean, cov = np.split(np.asarray(v, float), np.cumsum([s.states, s.states * s.states, s.states * d]))
        return States(first, move.reshape(s.states, -1), mean.reshape(s.states, d), cov.reshape(s.states, d, d))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _each(batch):
                found, seen = fitted(_matrix(row), s)
                yield pd.DataFrame({key: [getattr(row, key)], "m": [flat(found)], "seen": [seen]})

    short = packed.where("n_blocks = 1").mapInPandas(whole, f"{key} string, m array<double>, seen array<double>").collect()
    models, seen = {r[key]: model(r["m"]) for r in short}, {r[key]: list(r["seen"]) for r in short}
    assert all(len(r["m"]) == size for r in short)
    long = packed.where("n_blocks > 1")
    last = F.expr("transform(sequence(0, n - 1), k -> x[k * {0} + {1}])".format(d, d - 1))
    shares = F.array(*(F.lit(k / s.states) for k in range(1, s.states)))
    cuts = {r[key]: np.array(r["c"]) for r in long.select(key, F.explode(last).alias("v")).groupBy(key).agg(F.percentile_approx("v", shares, F.lit(100_000)).alias("c")).collect()}
    if not cuts:
        return Fits(models, seen)
    starts = _summed(long, lambda row: part_sums(_matrix(row), cuts[getattr(row, key)], s.states), key)
    open_ = {name: started(Sums.of(v, s.states, d), s.states, s.floor, s.diagonal) for name, v in starts.items()}
    for _ in range(s.rounds):
        now = dict(open_)
        ends = long.where(F.col(key).isin(list(now))) if len(now) < len(cuts) else long
        # a small matrix for each of the blocks, which are tens of thousands of rows
        bounds, likelihood = _ends(ends.select(key, "block", "n", "x").mapInPandas(_matrices(now, key), f"{key} string, block int, m array<double>, scale double").toPandas(), now, key)
        sums = _summed(ends, lambda row: smoothed(now[getattr(row, key)], _matrix(row), row.block == 0, *bounds[getattr(row, key), row.block])[1], key)
        for name, v in sums.items():
            before = seen.setdefault(name, [])
            before.append(likelihood[name])
            if len(before) > 1 and before[-1] - before[-2] < s.tolerance:
                models[name] = open_.pop(name).ordered()
            else:
                open_[name] = maximised(now[name], Sums.of(v, s.states, d), s.floor, s.diagonal)
        if not open_:
            break
    return Fits(models | {name: m.ordered() for name, m in open_.items()}, seen)


def _summed(packed: DataFrame, sums, key: str) -> dict[str, np.ndarray]:
    """The sums of the blocks of each series, added up by task and then by Spark: rows (key,
    place, value)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in _each(batch):
                name = getattr(row, key)
                found[name] = found.get(name, 0) + sums(row).flat()
        for name, v in found.items():
            yield pd.DataFrame({key: name, "place": np.arange(len(v)), "v": v})

    added = packed.select(key, "block", "n", "x").mapInPandas(each, f"{key} string, place int, v double").groupBy(key, "place").agg(F.sum("v").alias("v"))
    found: dict[str, list] = {}
    for r in sorted(added.collect(), key=lambda r: (r[key], r["place"])):
        found.setdefault(r[key], []).append(r["v"])
    return {name: np.array(some) for name, some in found.items()}


def _matrices(models: dict[str, States], key: str):
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _each(batch):
                whole, scale = product(models[getattr(row, key)], _matrix(row), row.block == 0)
                yield pd.DataFrame({key: [getattr(row, key)], "block": [row.block], "m": [whole.ravel().tolist()], "scale": [scale]})

    return matrices


def _scanned(first: np.ndarray, pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(vectors before each block, vectors behind each, log-likelihood) of a series' blocks, in order."""
    m = [np.asarray(v).reshape(len(first), -1) for v in pdf["m"]]
    now, total, before = first, float(pdf["scale"].sum()), []
    for one in m:
        before.append(now)
        now = now @ one
        total += math.log(now.sum())
        now = now / now.sum()
    behind = [np.ones(len(first))]
    for one in m[:0:-1]:
        back = one @ behind[-1]
        behind.append(back / back.sum())
    return before, behind[::-1], total


def _ends(found: pd.DataFrame, models: dict[str, States], key: str) -> tuple[dict, dict[str, float]]:
    """(the vectors at the ends of each block, by series and block; log-likelihoods by series)."""
    bounds, likelihood = {}, {}
    for name, pdf in found.groupby(key):
        pdf = pdf.sort_values("block")
        before, behind, likelihood[name] = _scanned(models[name].first, pdf)
        bounds |= {(name, block): ends for block, *ends in zip(pdf["block"].tolist(), before, behind, strict=True)}
    return bounds, likelihood


def _bounds(packed: DataFrame, models: dict[str, States], key: str) -> DataFrame:
    """(key, block, before, behind, likelihood): the vectors at the ends of each block, and
    the log-likelihood of the series."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        before, behind, total = _scanned(models[pdf[key].iloc[0]].first, pdf)
        return pd.DataFrame({key: pdf[key].to_numpy(), "block": pdf["block"].to_numpy(), "before": [v.tolist() for v in before], "behind": [v.tolist() for v in behind], "likelihood": total})

    found = packed.select(key, "block", "n", "x").mapInPandas(_matrices(models, key), f"{key} string, block int, m array<double>, scale double")
    return found.groupBy(key).applyInPandas(scan, f"{key} string, block int, before array<double>, behind array<double>, likelihood double")


def _path_ends(packed: DataFrame, models: dict[str, States], key: str) -> DataFrame:
    """(key, block, best, end): the best log-likelihoods before each block, and the state in
    which the most likely path leaves it."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _each(batch):
                yield pd.DataFrame({key: [getattr(row, key)], "block": [row.block], "m": [best_product(models[getattr(row, key)], _matrix(row), row.block == 0).ravel().tolist()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        first = models[pdf[key].iloc[0]].first
        m = [np.asarray(v).reshape(len(first), -1) for v in pdf["m"]]
        now, best = np.log(first + 1e-300), []
        for one in m:
            best.append(now)
            now = (now[:, None] + one).max(axis=0)
            now = now - now.max()
        end = [int(now.argmax())]
        for k in range(len(m) - 1, 0, -1):
            end.append(int((best[k] + m[k][:, end[-1]]).argmax()))
        return pd.DataFrame({key: pdf[key].to_numpy(), "block": pdf["block"].to_numpy(), "best": [v.tolist() for v in best], "end": end[::-1]})

    found = packed.select(key, "block", "n", "x").mapInPandas(matrices, f"{key} string, block int, m array<double>")
    return found.groupBy(key).applyInPandas(scan, f"{key} string, block int, best array<double>, end int")


def inferred(packed: DataFrame, models: dict[str, States], date: str = "date", key: str = "series") -> DataFrame:
    """(key, date, state, probs) of each row of blocks(): the most likely path, and the
    posteriors of all states."""
    some = packed.where(F.col(key).isin(list(models)))
    joined = some.join(_bounds(some, models, key), [key, "block"]).join(_path_ends(some, models, key), [key, "block"])
    kind = packed.schema["days"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _each(batch):
                model, x, begins = models[getattr(row, key)], _matrix(row), row.block == 0
                post, _ = smoothed(model, x, begins, np.asarray(row.before), np.asarray(row.behind))
                path = most_likely(model, x, begins, np.asarray(row.best), row.end)
                yield pd.DataFrame({key: getattr(row, key), date: list(row.days), "state": path, "probs": post.tolist()})

    return joined.mapInPandas(rows, f"{key} string, {date} {kind}, state int, probs array<double>")
