"""Embedding whitening with eigenvectors from QDWH spectral divide-and-conquer.

Spark gathers the exact second moments; the eigenproblem is that of a matrix of
dimension × dimension entries, solved on the driver; Spark applies the result.

1. Entries c become integers ``x = floor(scale * c) + offset``. The fit list holds
   each distinct integer vector once (a ``distinct`` with map-side combining, so
   a hot vector costs one row per task). Over it, Arrow batches sum n, S and the
   Gram matrix Σ yyᵀ of y = x - offset exactly (64-bit integer blocks added as
   Python integers, exchanged as decimal(38,0)); Spark adds the batches. Only these
   sums reach the driver: (d² + d) / 2 + d + 1 numbers, whatever the rows.
2. The covariance V = (n Σyyᵀ - S Sᵀ) / n² is formed exactly and rounded once.
   Its eigenvectors come from spectral divide-and-conquer: the polar factor U of
   V - σI, computed by the QR-based dynamically weighted Halley iteration (QDWH),
   is the matrix sign of V - σI, so P = (I + U) / 2 projects on the eigenvectors
   with eigenvalues above σ. An orthonormal basis of range(P) and of its
   complement splits V into two smaller symmetric problems, solved the same way
   until they are 1 × 1 or a multiple of the identity. σ is the mean of the
   eigenvalues, or the median of the diagonal when that does not split.
3. Rows are whitened in Arrow batches with the components shipped with the tasks (d × k
   doubles): (x - S/n) · u / sqrt(e); the covariance of the whitened fit list is
   measured in a second pass, and its largest departure from the identity is
   reported.

Defined cases: rows whose vector is null, holds a null or a non-finite entry, or
an entry of absolute value ``LIMIT`` or more (so that all sums are exact) are left
out. Shorter vectors are zero-padded to the longest kept one. Components are
those with an eigenvalue above ``1e-12`` times the trace, at most ``most``;
with fewer than two distinct vectors there are none and the result is empty.
The sign of a component makes its largest entry (first of equal ones) positive.
``deviation`` is null where it exceeds a long. Repeated rows are returned each.
Extra columns travel in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarflow.session import stored

LIMIT = float(2**20)
BLOCK = 256  # rows whose 64-bit products are summed before Python integers take over
RELATIVE_FLOOR = 1e-12


# --- QDWH polar decomposition and spectral divide-and-conquer --------------------------
def _qdwh_weights(low: float) -> tuple[float, float, float]:
    low2 = low * low
    gamma = (4.0 * (1.0 - low2) / (low2 * low2)) ** (1.0 / 3.0)
    a = math.sqrt(1.0 + gamma) + 0.5 * math.sqrt(8.0 - 4.0 * gamma + 8.0 * (2.0 - low2) / (low2 * math.sqrt(1.0 + gamma)))
    b = (a - 1.0) ** 2 / 4.0
    return a, b, a + b - 1.0


def polar(a: np.ndarray, low: float = 1e-15, limit: int = 60) -> np.ndarray:
    """Unitary polar factor of a square matrix by QDWH (QR form throughout)."""
    k = a.shape[0]
    alpha = np.linalg.norm(a, "fro")
    if alpha == 0:
        return np.eye(k)
    x = a / alpha
    eye = np.eye(k)
    for _ in range(limit):
        wa, wb, wc = _qdwh_weights(min(max(low, 1e-300), 1.0 - 1e-15))
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        step = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:k] @ q[k:].T)
        moved = np.linalg.norm(step - x, "fro")
        x = step
        low = min(low * (wa + wb * low * low) / (1.0 + wc * low * low), 1.0)
        if moved < 1e-15 ** (1 / 3) and abs(1.0 - low) < 1e-15 or moved < 1e-15:
            break
    return x


def _split(a: np.ndarray, sigma: float, draw: np.random.Generator):
    k = a.shape[0]
    sign = polar(a - sigma * np.eye(k))
    above = (sign + sign.T) / 4 + np.eye(k) / 2  # symmetric projector on eigenvalues > sigma
    r = int(round(float(np.trace(above))))
    if r in (0, k):
        return None
    # Bases of range(P) and of its complement from one QR; a second pass sharpens them.
    basis, _ = np.linalg.qr(np.hstack([above @ draw.standard_normal((k, r)), (np.eye(k) - above) @ draw.standard_normal((k, k - r))]))
    basis, _ = np.linalg.qr(np.hstack([above @ basis[:, :r], (np.eye(k) - above) @ basis[:, r:]]))
    return basis[:, :r], basis[:, r:]


def spectral(a: np.ndarray, draw: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors (columns) of a symmetric matrix, unordered."""
    draw = draw or np.random.default_rng(0)
    a = (a + a.T) / 2
    k = a.shape[0]
    if k == 0:
        return np.zeros(0), np.zeros((0, 0))
    if k == 1:
        return a.diagonal().copy(), np.eye(1)
    centre = np.trace(a) / k
    spread = np.linalg.norm(a - centre * np.eye(k), "fro")
    if spread <= 1e-15 * max(np.linalg.norm(a, "fro"), 1e-300):
        return a.diagonal().copy(), np.eye(k)
    parts = None
    for sigma in (centre, float(np.median(a.diagonal())), centre + spread / (2 * k), centre - spread / (2 * k)):
        parts = _split(a, sigma, draw)
        if parts:
            break
    if not parts:  # a cluster the shifts cannot cut: bisect the Gershgorin interval
        radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
        low, high = float((a.diagonal() - radius).min()), float((a.diagonal() + radius).max())
        for _ in range(60):
            sigma = (low + high) / 2
            parts = _split(a, sigma, draw)
            if parts:
                break
            sign = polar(a - sigma * np.eye(k))
            if np.trace(sign) > 0:
                low = sigma
            else:
                high = sigma
        if not parts:
            return a.diagonal().copy(), np.eye(k)
    values, vectors = [], []
    for q in parts:
        e, v = spectral(q.T @ a @ q, draw)
        values.append(e)
        vectors.append(q @ v)
    return np.concatenate(values), np.hstack(vectors)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the ``most`` leading components with e > 0."""
    values, vectors = spectral(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(cov))
    keep = values > RELATIVE_FLOOR * max(trace, 0.0)
    values, vectors = values[keep][:most], vectors[:, keep][:, :most]
    vectors = vectors / np.linalg.norm(vectors, axis=0, keepdims=True)
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return values, vectors


# --- Spark side -----------------------------------------------------------------------------
def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("_y").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


MOMENTS = "i int, j int, total decimal(38,0)"


def _moments(width: int):
    upper = np.triu_indices(width)

    def run(batches):
        gram = np.zeros((width, width), dtype=object)
        sums = np.zeros(width, dtype=object)
        n = 0
        for batch in batches:
            y = _matrix(batch, width)
            for at in range(0, y.shape[0], BLOCK):
                block = y[at : at + BLOCK]
                gram = gram + (block.T @ block).astype(object)
                sums = sums + block.sum(axis=0).astype(object)
                n += block.shape[0]
        if n == 0:
            return
        i = [-1, *[-1] * width, *upper[0].tolist()]
        j = [-1, *range(width), *upper[1].tolist()]
        totals = [n, *sums.tolist(), *gram[upper].tolist()]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array(i, pa.int32()),
                "j": pa.array(j, pa.int32()),
                "total": pa.array([decimal.Decimal(int(t)) for t in totals], pa.decimal128(38, 0)),
            }
        )

    return run


def _whiten(width: int, n: int, sums: list[int], scaled: np.ndarray, keep: list[str]):
    mean = np.array([float(s) / n for s in sums])
    exact = np.array(sums, dtype=object)
    k = scaled.shape[1]

    def run(batches):
        for batch in batches:
            y = _matrix(batch, width)
            rows = y.shape[0]
            white = (y - mean) @ scaled
            gaps = y.astype(object) * n - exact
            deviation = [int(d) if d < 2**63 else None for d in (gaps * gaps).sum(axis=1)] if rows else []
            take = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(name).take(pa.array(take)) for name in keep]
                + [
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array([deviation[r] for r in take], pa.int64()),
                    pa.array(white.reshape(-1), pa.float64()),
                ],
                names=[*keep, "component", "deviation", "whitened"],
            )

    return run


def _white_moments(width: int, mean: np.ndarray, scaled: np.ndarray):
    k = scaled.shape[1]

    def run(batches):
        gram, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            w = (_matrix(batch, width) - mean) @ scaled
            gram += w.T @ w
            sums += w.sum(axis=0)
            n += w.shape[0]
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [sums.tolist()], "gram": [gram.reshape(-1).tolist()]})

    return run


@dataclass
class Whitened:
    rows: DataFrame  # row, component, deviation, whitened
    n: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def whiten(
    vectors: DataFrame,
    vector_column: str = "embedding",
    scale: int = 64,
    offset: int = 1_000_000,
    most: int = 16,
) -> Whitened:
    """Fit on the distinct integer vectors, whiten every row that takes part."""
    entry = F.col(vector_column).cast("array<double>")
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    kept = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"),
        F.transform(entry, lambda c: F.floor(c * scale)).cast("array<long>").alias("_y"),
    )
    kept = stored(kept, "whitening-rows")
    width = kept.agg(F.max(F.size("_y"))).first()[0] or 0
    kept = kept.select("row", F.concat("_y", F.array_repeat(F.lit(0).cast("long"), width - F.size("_y"))).alias("_y"))
    fit = stored(kept.select("_y").distinct(), "whitening-fit")
    sums = fit.mapInArrow(_moments(width), MOMENTS).groupBy("i", "j").agg(F.sum("total").alias("t")).collect()
    got = {(r["i"], r["j"]): int(r["t"]) for r in sums}
    n = got.get((-1, -1), 0)
    schema = T.StructType(
        [
            kept.schema["row"],
            T.StructField("component", T.IntegerType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
        ]
    )
    if n < 2 or width == 0:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return Whitened(empty, n, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    s = [got[(-1, d)] for d in range(width)]
    exact = [[0] * width for _ in range(width)]
    for a in range(width):
        for b in range(a, width):
            exact[a][b] = exact[b][a] = n * got[(a, b)] - s[a] * s[b]
    cov = np.array([[float(decimal.Decimal(v) / decimal.Decimal(n * n)) for v in line] for line in exact])
    values, vecs = components(cov, most)
    scaled = vecs / np.sqrt(values)
    mean = np.array([float(v) / n for v in s])
    measured = fit.mapInArrow(_white_moments(width, mean, scaled), "n long, sums array<double>, gram array<double>").collect()
    k = scaled.shape[1]
    gram, wsum = np.zeros((k, k)), np.zeros(k)
    for r in measured:
        gram += np.array(r["gram"]).reshape(k, k)
        wsum += np.array(r["sums"])
    white_cov = gram / n - np.outer(wsum / n, wsum / n)
    error = float(np.abs(white_cov - np.eye(k)).max()) if k else 0.0
    rows = kept.mapInArrow(_whiten(width, n, s, scaled, ["row"]), schema)
    return Whitened(rows, n, values, vecs, float(np.trace(cov)), error)
