"""Start weights fitted by descent from many starts at once.

The starts of a stop codon are put into one row, once; a round is then a map over those rows and a sum. Every task adds up losses and
gradients of all starting points in small arrays, and one row per task is merged, so a round costs one pass whatever
the number of starting points. The driver keeps five weights and a five by five matrix per starting point and takes
projected quasi-Newton steps within bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codonlake import constants as C
from codonlake.operators.orf import GROUP
from codonlake.operators.sweeps import NORMS
from codonlake.session import stored

LEAST_SHARE = 1e-300


def group_rows(groups: DataFrame) -> DataFrame:
    """One row per group: ``true`` (components of the true start) and ``members`` (those of all starts, one after the other)."""
    parts = F.array(*[F.col(n).cast("double") for n in NORMS])
    return groups.groupBy(*GROUP).agg(F.max(F.when(F.col("is_true") == 1, parts)).alias("true"), F.flatten(F.collect_list(parts)).alias("members")).where(
        F.col("true").isNotNull()).select("true", "members")


def losses(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean cross-entropy of the true start under a softmax per group, and its gradient, for each row of ``weights``."""
    n, k = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, loss, grad = 0, np.zeros(n), np.zeros((n, k))
        for b in batches:
            if not b.num_rows:
                continue
            true = b.column("true").flatten().to_numpy().reshape(-1, k)
            sizes = np.diff(b.column("members").offsets.to_numpy()) // k
            members = b.column("members").flatten().to_numpy().reshape(-1, k)
            first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            score = members @ weights.T
            score -= np.maximum.reduceat(score, first)[of]
            e = np.exp(score)
            z = np.add.reduceat(e, first)
            top = true @ weights.T - np.maximum.reduceat(members @ weights.T, first)
            loss -= np.log(np.maximum(np.exp(top) / z, LEAST_SHARE)).sum(axis=0)
            grad += (e / z[of]).T @ members - true.sum(axis=0)
            groups += len(sizes)
        yield pa.RecordBatch.from_pydict({"groups": [groups], "sums": [np.concatenate((loss, grad.ravel())).tolist()]})

    made = rows.mapInArrow(run, "groups long, sums array<double>")
    total = made.agg(F.sum("groups"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(n * (k + 1))])).first()
    sums = np.array(total[1], dtype=float) / max(1, total[0] or 0) if total[0] else np.zeros(n * (k + 1))
    return sums[:n], sums[n:].reshape(n, k)


def descend_all(groups: DataFrame, starts: dict[str, dict[str, float]], rounds: int = 40, bounds: tuple[float, float] = (0.01, 20.0),
                tolerance: float = 1e-5) -> DataFrame:
    """One row per starting point: start_loss, loss, rounds, and the weights, rescaled to the largest one of the start.

    A step that does not lower the loss enough is halved and tried again in the next round, for all starting points in one pass.
    """
    low, high = bounds
    rows, names = stored(group_rows(groups)), list(starts)
    x = np.clip(np.array([[starts[s][c] for c in C.COMPONENTS] for s in names], dtype=float), low, high)
    f, g = losses(rows, x)
    first, used = f.copy(), np.zeros(len(x), dtype=int)
    inverse, length = np.stack([np.eye(x.shape[1])] * len(x)), np.ones(len(x))
    for _ in range(rounds):
        stuck = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))  # at a bound, and the loss falls beyond it
        free = ~stuck
        live = np.abs(np.where(free, g, 0.0)).max(axis=1) > tolerance
        if not live.any():
            break
        direction = np.zeros_like(x)
        for i in np.flatnonzero(live):
            own = np.flatnonzero(free[i])
            step = -inverse[i][np.ix_(own, own)] @ g[i, own]
            if step @ g[i, own] >= 0:  # no longer a descent direction
                inverse[i], step = np.eye(x.shape[1]), -g[i, own]
            direction[i, own] = step
        tried = np.clip(x + length[:, None] * direction, low, high)
        new_f, new_g = losses(rows, tried)
        for i in np.flatnonzero(live):
            used[i] += 1
            s, y = tried[i] - x[i], new_g[i] - g[i]
            if new_f[i] > f[i] + 1e-4 * (g[i] @ s) or not s.any():
                length[i] /= 2
                continue
            if s @ y > 1e-12:
                left = np.eye(len(s)) - np.outer(s, y) / (s @ y)
                inverse[i] = left @ inverse[i] @ left.T + np.outer(s, s) / (s @ y)
            x[i], f[i], g[i], length[i] = tried[i], new_f[i], new_g[i], 1.0
    scale = np.array([max(starts[s].values()) for s in names]) / x.max(axis=1)
    out = [(s, float(first[i]), float(f[i]), int(used[i]), *[float(v) for v in x[i]], *[float(v * scale[i]) for v in x[i]]) for i, s in enumerate(names)]
    columns = ", ".join([f"{c} double" for c in C.COMPONENTS] + [f"{c}_rescaled double" for c in C.COMPONENTS])
    return rows.sparkSession.createDataFrame(out, f"point string, start_loss double, loss double, rounds int, {columns}")


def starting_points(base: dict[str, float]) -> dict[str, dict[str, float]]:
    """The base weights, equal weights, and for every component the base with that weight at a tenth and at three times."""
    out = {"base": dict(base), "equal": {c: 1.0 for c in C.COMPONENTS}}
    for c in C.COMPONENTS:
        for factor in (0.1, 3.0):
            out[f"{c}*{factor:g}"] = base | {c: base[c] * factor}
    return out
