"""Many logistic regressions in shared passes over the data.

A job is one model: a label, the arms and folds it trains on, and a penalty. Jobs differ
in rows, never in the table: each row carries a cell (arm and fold), and a job trains
on a set of cells, such as all folds but one. Statistics that add up (counts, means,
variances, the histograms behind the medians) are read once per cell, and a training fold is
the cells' total without its own part. Newton steps weigh every row anew for every
job; each pass sums loss, gradient and Gram matrix of all jobs at once, task by task,
so twenty models cost as many passes as one.

The model: missing values become the training rows' exact median, inputs are centred and
scaled by the sample deviation, the penalty is the squared coefficients of the scaled
inputs over 2 C, the intercept is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgeframe.plans.selection import medians
from nudgeframe.session import over_all_cores

#: Largest change of a coefficient at which a fit ends.
TOLERANCE = 1e-9
LABELS = ("target", "transformed")
ARM = "__treatment__"


@dataclass(frozen=True)
class Job:
    """One model to fit: ``cells`` are (arm, fold) pairs, ``label`` one of LABELS."""

    label: str
    cells: frozenset
    with_arm: bool = False
    C: float = 1.0
    max_iter: int = 500


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on the inputs as they come, medians for missing ones, or a constant probability.

    ``scaled`` are the coefficients on the scaled inputs.
    """

    inputs: tuple
    medians: tuple = ()
    weights: tuple = ()
    intercept: float = 0.0
    scaled: tuple = ()
    constant: float | None = None
    passes: int = 0

    def margin(self, arm: float | None = None) -> Column:
        """Sum of the weighted inputs; ``arm`` stands in for the arm's column."""
        out = F.lit(float(self.intercept))
        for name, middle, weight in zip(self.inputs, self.medians, self.weights):
            value = F.lit(arm) if name == ARM and arm is not None else F.coalesce(F.col(name).cast("double"), F.lit(float(middle)))
            out = out + value * F.lit(float(weight))
        return out

    def probability(self, arm: float | None = None) -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        return 1 / (1 + F.exp(-self.margin(arm)))


@dataclass
class _State:
    beta: np.ndarray
    before: np.ndarray | None = None
    loss: float = np.inf
    passes: int = 0
    done: bool = False


def _moments(rows: DataFrame, columns: list[str]) -> dict:
    """{cell: (rows, sums of both labels, counts, means, squared deviations)}."""
    found = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(label).alias(label) for label in LABELS],
        *[f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("c", F.count), ("m", F.avg), ("v", F.var_pop))],
    ).collect()
    take = lambda r, name: np.array([r[f"{name}{i}"] or 0.0 for i in range(len(columns))])
    return {r["cell"]: (r["n"], [r[label] for label in LABELS], take(r, "c"), take(r, "m"), take(r, "v") * take(r, "c")) for r in found}


def _pooled(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and squared deviations of several parts together."""
    n, mean, apart = (np.zeros_like(x) for x in parts[0])
    for k, m, v in parts:
        both = np.maximum(n + k, 1.0)
        apart = apart + v + (m - mean) ** 2 * n * k / both
        mean = mean + (m - mean) * k / both
        n = n + k
    return n, mean, apart


def _pass(rows: DataFrame, columns: list[str], work: list[tuple]) -> dict[int, np.ndarray]:
    """{job: loss, gradient and Gram matrix in one array}, summed over its cells' rows.

    ``work`` lists (job, cells of the job, label, medians, means, scales, coefficients).
    """
    size = len(columns) + 1

    def run(batches):
        totals = {job: np.zeros(1 + size + size * size) for job, *_ in work}
        for batch in batches:
            cell = batch.column(0).to_numpy()
            labels = [batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(LABELS))]
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(1 + len(LABELS), batch.num_columns)])
            missing = np.isnan(x)
            for job, cells, label, middle, mean, scale, beta in work:
                mine = np.isin(cell, cells)
                if not mine.any():
                    continue
                z = np.ones((int(mine.sum()), size))
                z[:, :-1] = (np.where(missing[mine], middle, x[mine]) - mean) * scale
                y, eta = labels[label][mine], z @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total = totals[job]
                total[0] += float((np.logaddexp(0, eta) - y * eta).sum())
                total[1 : 1 + size] += z.T @ (p - y)
                total[1 + size :] += (z.T @ (z * (p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["job", "sums"])

    def added(batches):
        totals = {}
        for batch in batches:
            for job, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals[job] = totals.get(job, 0.0) + sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["job", "sums"])

    schema = "job int, sums array<double>"
    parts = rows.select("cell", *LABELS, *columns).mapInArrow(run, schema)
    spread = parts.repartition(len(work), "job").mapInArrow(added, schema)
    return {r["job"]: np.array(r["sums"]) for r in spread.collect()}


def _advance(state: _State, sums: np.ndarray, free: np.ndarray, C: float, max_iter: int) -> None:
    """One Newton step, or half a step back where the last one made the loss larger."""
    size = len(state.beta)
    ridge = np.where(np.arange(size) < size - 1, 1.0 / C, 0.0)
    loss = sums[0] + 0.5 * float(ridge @ state.beta**2)
    state.passes += 1
    if loss > state.loss + 1e-9 * abs(state.loss) and state.before is not None:
        state.beta = 0.5 * (state.beta + state.before)
    else:
        gradient = sums[1 : 1 + size] + ridge * state.beta
        gram = sums[1 + size :].reshape(size, size) + np.diag(ridge)
        step = np.zeros(size)
        step[free] = np.linalg.lstsq(gram[np.ix_(free, free)], gradient[free], rcond=None)[0]
        state.before, state.loss, state.beta = state.beta, loss, state.beta - step
        state.done = float(np.abs(step).max()) <= TOLERANCE * max(1.0, float(np.abs(state.beta).max()))
    state.done |= state.passes >= max_iter


def fit_jobs(rows: DataFrame, columns: list[str], jobs: list[Job]) -> list[LinearModel]:
    """A model per job. ``rows`` has arm (0 or 1), fold, both labels and the columns as doubles."""
    folds = 1 + max(fold for job in jobs for _, fold in job.cells)
    inputs = [*columns, ARM]
    cell = (F.col("arm") * folds + F.col("fold")).cast("int").alias("cell")
    rows = rows.filter(F.col("target").isNotNull() & F.col("arm").isNotNull())
    rows = rows.select(cell, *[F.col(c).cast("double").alias(c) for c in LABELS], *columns, F.col("arm").cast("double").alias(ARM))
    rows = over_all_cores(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = _moments(rows, inputs)
        cells = [[arm * folds + fold for arm, fold in job.cells] for job in jobs]
        own = [[seen[c] for c in job_cells if c in seen] for job_cells in cells]
        groups = {str(sorted(c)): c for c in cells}
        known = {(str(sorted(c)), name): int(sum(s[2][i] for s in o)) for c, o in zip(cells, own) for i, name in enumerate(inputs)}
        middle = medians(rows, inputs, groups, known)
        work, states, out = [], {}, [None] * len(jobs)
        for k, job in enumerate(jobs):
            n = sum(s[0] for s in own[k])
            label = LABELS.index(job.label)
            positive = sum(s[1][label] for s in own[k])
            has = np.array([known[str(sorted(cells[k])), c] > 0 for c in inputs])
            has[-1] &= job.with_arm
            used = tuple(c for c, h in zip(inputs, has) if h)
            if n == 0 or positive in (0, n) or not used:
                out[k] = LinearModel(used, constant=positive / n if n else 0.0)
                continue
            fill = np.array([middle[str(sorted(cells[k])), c] if h else 0.0 for c, h in zip(inputs, has)])
            parts = [(s[2], s[3], s[4]) for s in own[k]]
            count = sum(p[0] for p in parts)
            _, mean, apart = _pooled([*parts, (n - count, fill, np.zeros(len(inputs)))])
            deviation = np.sqrt(apart / max(n - 1, 1))
            scale = np.where(has & (deviation > 0), 1 / np.where(deviation > 0, deviation, 1.0), 0.0)
            beta = np.zeros(len(inputs) + 1)
            beta[-1] = np.log(positive / (n - positive))
            states[k] = _State(beta)
            work.append((k, np.array(cells[k]), label, fill, mean, scale))
        while any(not s.done for s in states.values()):
            active = [(*w, states[w[0]].beta) for w in work if not states[w[0]].done]
            for k, sums in _pass(rows, inputs, active).items():
                free = np.append(next(w[5] for w in work if w[0] == k) > 0, True)
                _advance(states[k], sums, free, jobs[k].C, jobs[k].max_iter)
    finally:
        rows.unpersist()
    for k, _, _, fill, mean, scale in work:
        beta = states[k].beta
        has = [i for i, c in enumerate(inputs) if known[str(sorted(cells[k])), c] and (c != ARM or jobs[k].with_arm)]
        raw = beta[:-1] * scale
        pick = lambda values: tuple(float(values[i]) for i in has)
        out[k] = LinearModel(
            tuple(inputs[i] for i in has), pick(fill), pick(raw), float(beta[-1] - raw @ mean), pick(beta[:-1]), passes=states[k].passes
        )
    return out
