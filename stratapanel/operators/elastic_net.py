"""Cross-validated elastic net, by active sets on Gram matrices.

Objective: squared error / 2n + lambda * (alpha * |b|_1 + (1 - alpha) / 2 * |b|_2^2) with X and y scaled to unit
population variance. Constant features get coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS, PATH = 5, 100
MIN_TRAIN = 60


def no_rows(*names: str) -> pd.DataFrame:
    """An empty frame whose columns fit any type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


@dataclass
class Gram:
    """Sufficient statistics of some rows."""

    n: float
    sx: np.ndarray
    sy: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Gram:
        return cls(len(x), x.sum(0), float(y.sum()), x.T @ x, x.T @ y, float(y @ y))

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.sx - other.sx, self.sy - other.sy, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sx + other.sx, self.sy + other.sy, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def squared_error(self, b: np.ndarray) -> float:
        """Sum of squared errors of these rows with intercept and slopes ``b``: a quadratic form of the sums."""
        slope = b[1:]
        return float(self.yy - 2 * (b[0] * self.sy + slope @ self.xy) + b[0] ** 2 * self.n + 2 * b[0] * (slope @ self.sx) + slope @ self.xx @ slope)

    def scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray, float]:
        """Correlations of X, of X with y, and the means and deviations."""
        mx, my = self.sx / self.n, self.sy / self.n
        cov, cxy, vy = self.xx / self.n - np.outer(mx, mx), self.xy / self.n - mx * my, self.yy / self.n - my * my
        spread = np.diag(self.xx) / self.n
        sx = np.sqrt(np.where(np.diag(cov) > 1e-12 * np.maximum(spread, 1e-300), np.diag(cov), 0))
        sy = float(np.sqrt(max(vy, 0)))
        with np.errstate(divide="ignore", invalid="ignore"):
            inv = np.where(sx > 0, 1 / sx, 0)
        return cov * inv[:, None] * inv, cxy * inv / sy if sy > 0 else cxy * 0, inv, my, mx, sy


def descend(r: np.ndarray, c: np.ndarray, lam: float, alpha: float, start: np.ndarray, rounds: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    b = start.copy()
    live = np.flatnonzero(np.diag(r) > 0)
    g = c - r @ b
    for _ in range(rounds):
        moved = 0.0
        for j in live:
            z = g[j] + b[j]
            new = np.sign(z) * max(abs(z) - lam * alpha, 0) / (1 + lam * (1 - alpha))
            if new != b[j]:
                g -= r[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved < tolerance:
            break
    return b


def minimise(r: np.ndarray, c: np.ndarray, lam: float, alpha: float, start: np.ndarray, rounds: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """The minimum by active sets: the equations of the coefficients that aren't zero are solved exactly, from ``start`` a coefficient that would change
    its sign leaves at zero, and the one that violates its condition most enters. If that doesn't settle, coordinate descent goes on from there.
    """
    pull, ridge = lam * alpha, lam * (1 - alpha)
    live = np.diag(r) > 0
    b = np.where(live, start, 0.0)
    sign = np.sign(b)
    for _ in range(rounds):
        at = np.flatnonzero(sign)
        if len(at):
            try:
                goal = np.linalg.solve(r[np.ix_(at, at)] + ridge * np.eye(len(at)), c[at] - pull * sign[at])
            except np.linalg.LinAlgError:
                break
            wrong = goal * sign[at] <= 0
            if wrong.any():
                now = b[at]
                share = np.where(wrong, now / np.where(now == goal, 1, now - goal), np.inf)
                first = int(share.argmin())
                b[at] = now + max(share[first], 0.0) * (goal - now)
                b[at[first]] = sign[at[first]] = 0.0
                continue
            b[at] = goal
        slack = np.where(live & (sign == 0), np.abs(c - r @ b) - pull, -np.inf)
        enters = int(slack.argmax())
        if slack[enters] <= tolerance:
            return b
        sign[enters] = np.sign(c[enters] - r[enters] @ b)
    return descend(r, c, lam, alpha, b)


def lambda_path(c: np.ndarray, n: float, p: int, alpha: float, size: int = PATH) -> np.ndarray:
    top = np.abs(c).max(initial=0) / max(alpha, 1e-3)
    return np.geomspace(top, top * (1e-4 if n >= p else 1e-2), size) if top > 0 else np.zeros(1)


def fit_path(gram: Gram, lambdas: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients, on the original scale, for each lambda."""
    r, c, inv, my, mx, sy = gram.scaled()
    b, out = np.zeros(len(c)), np.zeros((len(lambdas), len(c) + 1))
    for k, lam in enumerate(lambdas):
        b = minimise(r, c, lam, alpha, b)
        out[k, 1:] = b * inv * sy
        out[k, 0] = my - out[k, 1:] @ mx
    return out


def best_of_path(folds: list[Gram], alpha: float = 0.5) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first) at the lambda of least mean squared error over the folds, and that lambda, from the folds' sums alone."""
    whole = sum(folds[1:], folds[0])
    _, c, *_ = whole.scaled()
    lambdas = lambda_path(c, whole.n, len(whole.sx), alpha)
    loss = np.zeros(len(lambdas))
    for fold in folds if len(folds) > 1 else []:
        loss += [fold.squared_error(b) for b in fit_path(whole - fold, lambdas, alpha)]
    best = int(np.argmin(loss))
    return fit_path(whole, lambdas[: best + 1], alpha)[-1], float(lambdas[best])


def cross_validated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, alpha: float = 0.5) -> tuple[np.ndarray, float]:
    """``best_of_path`` of rows at hand."""
    return best_of_path([Gram.of(x[fold == f], y[fold == f]) for f in np.unique(fold)], alpha)


def with_folds(rows: DataFrame, seed: int, folds: int = FOLDS) -> DataFrame:
    """``fold`` by a seeded hash of the key, so that it doesn't depend on how rows are dealt."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "permno", "date_eom"), F.lit(folds)).cast("int"))


def long_schemes(rows: DataFrame, schemes: dict[str, str], drop_null: bool = True) -> DataFrame:
    """A row for each scheme, with its group in ``grp``; rows without a group are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("scheme"), F.col(c).cast("string").alias("grp")) for n, c in schemes.items()])
    out = rows.select("*", F.inline(pairs))
    return out.where("grp is not null") if drop_null else out


def fit_groups(rows: DataFrame, features: tuple[str, ...], label: str, alpha: float = 0.5, min_train: int = MIN_TRAIN) -> DataFrame:
    """``scheme``, ``grp``, ``n_train`` and ``beta`` (intercept first) of each group with at least ``min_train`` rows of 'train'.

    Products are summed up by group and fold where the rows are, then over tasks; a model is fitted from its folds' sums, so no group's rows meet in
    one task. A task holds a matrix for each group and fold that it sees.
    """
    names = [*features, label]
    size = len(names) + 1

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(["scheme", "grp", "fold"], sort=False):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                sums[key] = sums.get(key, 0) + x.T @ x
        if sums:
            scheme, grp, fold = zip(*sums, strict=True)
            yield pd.DataFrame({"scheme": scheme, "grp": grp, "fold": fold, "sums": [m.ravel().tolist() for m in sums.values()]})

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        folds = []
        for values in part.sort_values("fold")["sums"]:
            m = np.array([v["s"] for v in values]).reshape(size, size)
            folds.append(Gram(m[0, 0], m[0, 1:-1], m[0, -1], m[1:-1, 1:-1], m[1:-1, -1], m[-1, -1]))
        n = round(sum(g.n for g in folds))
        if n < min_train:
            return no_rows("scheme", "grp", "n_train", "beta")
        return pd.DataFrame({"scheme": [key[0]], "grp": [key[1]], "n_train": [n], "beta": [best_of_path(folds, alpha)[0].tolist()]})

    train = rows.where("split = 'train'").select("scheme", "grp", "fold", *[F.col(c).cast("double").alias(c) for c in names])
    cells = train.mapInPandas(add_up, "scheme string, grp string, fold int, sums array<double>").select("scheme", "grp", "fold", F.posexplode("sums").alias("cell", "s"))
    cells = cells.groupBy("scheme", "grp", "fold", "cell").agg(F.sum("s").alias("s"))
    packed = cells.groupBy("scheme", "grp", "fold").agg(F.array_sort(F.collect_list(F.struct("cell", "s"))).alias("sums"))
    return packed.groupBy("scheme", "grp").applyInPandas(fit, "scheme string, grp string, n_train bigint, beta array<double>")


def predict_groups(rows: DataFrame, features: tuple[str, ...], label: str, alpha: float = 0.5, min_train: int = MIN_TRAIN) -> DataFrame:
    """Predictions of the ``split`` = 'test' rows of each (scheme, grp) with at least ``min_train`` rows of 'train'.

    ``rows`` has scheme, grp, split, fold, the label and the features. Scoring is one join with the few models and a sum of columns.
    """
    models = fit_groups(rows, features, label, alpha, min_train)
    joined = rows.where("split = 'test'").join(models, ["scheme", "grp"])
    fitted = sum((F.get("beta", F.lit(k + 1)) * F.col(f) for k, f in enumerate(features)), F.get("beta", F.lit(0)))
    return joined.select("scheme", "grp", F.col("permno").cast("bigint").alias("permno"), "date_eom", "n_train", F.col(label).cast("double").alias("y_true"), fitted.alias("y_hat"))


def predict_pooled(rows: DataFrame, features: tuple[str, ...], label: str, alpha: float = 0.5) -> DataFrame:
    """One model of all 'train' rows, as a group of its own."""
    return predict_groups(rows.withColumns({"scheme": F.lit("Pooled"), "grp": F.lit("pooled")}), features, label, alpha, 1)


def one_hot(rows: DataFrame, column: str, values: list) -> tuple[DataFrame, tuple[str, ...]]:
    """Indicator columns of all but the first of ``values`` (treatment contrasts), and their names."""
    names = tuple(f"{column}_{v}" for v in values[1:])
    return rows.withColumns({n: (F.col(column).eqNullSafe(F.lit(v))).cast("double") for n, v in zip(names, values[1:], strict=True)}), names
