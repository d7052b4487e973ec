"""Whitening of vectors: principal components by spectral divide and conquer with QDWH polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.vectors import by_width, matrix
from panelcast.operators.sizing import cut_lineage

#: Entries become integers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Scaled entries beyond this are taken as this: a long and a double hold all integers up to it.
LARGEST = 1 << 53
EPS = float(np.finfo(float).eps)
#: Bytes of the tables that a task of the last pass receives.
MAX_BROADCAST_BYTES = 64 << 20
#: True for a vector with entries, all of them finite.
FINITE = "coalesce(size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley iteration (QDWH).

    The first iterations use QR, later ones, which are well conditioned, Cholesky.  Singular values down to the rounding error
    of the norm reach 1 within six iterations; the factor of the null matrix is taken as the identity.
    """
    n = len(a)
    eye = np.eye(n)
    size = float(np.linalg.norm(a))
    if size == 0 or not np.isfinite(size):
        return eye
    x, low = a / size, EPS / 4
    for _ in range(12):
        if abs(1 - low) <= 8 * EPS:
            break
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        w = np.sqrt(1 + d)
        p = w + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * w)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            half = np.linalg.inv(np.linalg.cholesky(eye + r * x.T @ x))
            x = q / r * x + (p - q / r) * (x @ half.T) @ half
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
    # One Newton-Schulz step takes out what rounding left.
    return 1.5 * x - 0.5 * x @ x @ x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int, float]:
    """(basis, k, coupling): the first k columns span the invariant subspace of eigenvalues above ``shift``, the others its complement."""
    n = len(a)
    upper = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(upper))))
    if not 0 < k < n:
        return np.eye(n), k, np.inf
    dice = np.random.default_rng(n).standard_normal((n, n))
    basis = np.hstack([upper @ dice[:, :k], dice[:, k:] - upper @ dice[:, k:]])
    # A second application makes up for a start that was nearly within the other subspace.
    basis = np.linalg.qr(basis)[0]
    basis = np.linalg.qr(np.hstack([upper @ basis[:, :k], basis[:, k:] - upper @ basis[:, k:]]))[0]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def components_of(v: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling, the first ``wanted``.

    A subspace is split at the median of its diagonal, else at other places between its eigenvalues, until it has one dimension or is, to rounding,
    a multiple of the identity; a subspace that holds none of the wanted components is left alone.
    """
    d = len(v)
    wanted = d if wanted is None else min(wanted, d)
    v = (v + v.T) / 2
    tiny = d * EPS * float(np.linalg.norm(v))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    stack = [(v, np.eye(d))]
    while stack and len(values) < wanted:
        a, basis = stack.pop()
        n = len(a)
        mean = float(np.trace(a)) / n
        if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= tiny:
            values += [float(a[i, i]) for i in range(n)]
            vectors += [basis[:, i] for i in range(n)]
            continue
        diagonal = np.sort(np.diag(a))
        spread = float(np.linalg.norm(a - mean * np.eye(n))) / np.sqrt(n)
        tries = [float(np.median(diagonal)), mean, *(mean + f * spread for f in (0.25, -0.25, 0.5, -0.5, 0.125, -0.125, 0.0625))]
        best: tuple[float, np.ndarray, int] | None = None
        for shift in tries:
            turn, k, coupling = split(a, shift)
            if 0 < k < n and (best is None or coupling < best[0]):
                best = (coupling, turn, k)
            if best is not None and best[0] <= 4 * tiny:
                break
        if best is None:
            raise ArithmeticError("no shift separates the eigenvalues")
        _, turn, k = best
        inner = turn.T @ a @ turn
        inner = (inner + inner.T) / 2
        stack.append((inner[k:, k:], basis @ turn[:, k:]))
        stack.append((inner[:k, :k], basis @ turn[:, :k]))
    found = np.stack(vectors, axis=1)
    found = found / np.sqrt((found * found).sum(axis=0))
    rayleigh = np.einsum("ij,ij->j", found, v @ found)
    order = np.argsort(-rayleigh, kind="stable")[:wanted]
    return rayleigh[order], found[:, order]


@dataclass
class Whitening:
    """Of the vectors of one length: how many there are, their exact sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        return self.values > len(self.sums) * EPS * max(self.trace, 0.0)

    @property
    def projection(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened components; NaN without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.vectors / np.sqrt(np.where(self.usable, self.values, np.nan))


def as_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of every entry; scaled entries beyond ``LARGEST`` are cut to it."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _exact_sums(x: np.ndarray) -> list[int]:
    fits = int(np.abs(x).max()) * len(x) < 1 << 62
    return [int(s) for s in (x if fits else x.astype(object)).sum(axis=0)]


def _merge(n: int, mean: np.ndarray, m2: np.ndarray, n2: int, mean2: np.ndarray, m22: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and sums of centred products of two sets together."""
    total = n + n2
    gap = mean2 - mean
    return total, mean + gap * (n2 / total), m2 + m22 + np.outer(gap, gap) * (n * n2 / total)


def _partials(rows: DataFrame, prepare) -> DataFrame:
    """(width, n, sums, mean, m2): one row per task and vector length, products centred before they are multiplied.

    ``prepare`` turns a matrix of vectors of one length into integers, or None, and the doubles whose moments are taken.
    """
    schema = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
                        ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for width, part in by_width(batch, 0):
                whole, x = prepare(width, matrix(part.column(0)))
                if whole is not None:
                    sums[width] = [a + b for a, b in zip(sums.get(width) or [0] * width, _exact_sums(whole))]
                mean = x.mean(axis=0)
                z = x - mean
                now = (len(x), mean, z.T @ z)
                held[width] = _merge(*held[width], *now) if width in held else now
        for width, (n, mean, m2) in held.items():
            yield pa.RecordBatch.from_pylist([{"width": width, "n": n, "sums": [Decimal(s) for s in sums.get(width, [])],
                                               "mean": mean.tolist(), "m2": m2.ravel().tolist()}], schema)

    return cut_lineage(rows.select("vec").mapInArrow(run, "width int, n long, sums array<decimal(38,0)>, mean array<double>, m2 array<double>"))


def _added(parts: DataFrame, column: str) -> dict[int, list]:
    """For each vector length the entries of an array column, added up by Spark."""
    cells = parts.select("width", F.posexplode(column).alias("cell", "x")).groupBy("width", "cell").agg(F.sum("x").alias("x")).toArrow()
    found: dict[int, list] = {}
    for width, _, x in sorted(zip(*(cells[c].to_pylist() for c in ("width", "cell", "x")))):
        found.setdefault(width, []).append(x)
    return found


def _covariances(parts: DataFrame, counts: dict[int, int], means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each vector length the covariance of all rows, divisor n, from the partial moments of ``_partials``."""

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                gap = np.array(row["mean"]) - means[row["width"]]
                m2 = np.array(row["m2"]) + row["n"] * np.outer(gap, gap).ravel()
                yield pa.RecordBatch.from_pylist([{"width": row["width"], "m2": m2.tolist()}],
                                                 pa.schema([("width", pa.int32()), ("m2", pa.list_(pa.float64()))]))

    rows = parts.select("width", "n", "mean", "m2").mapInArrow(corrected, "width int, m2 array<double>")
    return {w: np.array(m2).reshape(len(means[w]), -1) / counts[w] for w, m2 in _added(rows, "m2").items()}


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows whose vector has entries, all of them finite."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where(FINITE)


def _counts(parts: DataFrame) -> dict[int, int]:
    return {r.width: r.n for r in parts.groupBy("width").agg(F.sum("n").alias("n")).collect()}


def fit(rows: DataFrame, wanted: int = 8) -> dict[int, Whitening]:
    """The whitening of each vector length in ``rows`` (id, vec), from one pass over all vectors.

    Each task returns exact sums and centred moments; Spark adds them up, the driver gets one matrix for each length.
    """
    parts = _partials(rows, lambda width, x: ((whole := as_integers(x)), whole.astype(float)))
    counts = _counts(parts)
    sums = {w: [int(s) for s in found] for w, found in _added(parts, "sums").items()}
    means = {w: np.array([s / counts[w] for s in found]) for w, found in sums.items()}
    fitted = {}
    for w, v in _covariances(parts, counts, means).items():
        values, vectors = components_of(v, wanted)
        fitted[w] = Whitening(counts[w], sums[w], float(np.trace(v)), values, vectors)
    return fitted


def identity_error(rows: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """For each vector length the largest absolute entry of the covariance of the whitened vectors less the identity.

    Components without variance are left out; 0 if there is no other.
    """

    def prepare(width: int, x: np.ndarray) -> tuple[None, np.ndarray]:
        f = fitted[width]
        return None, (as_integers(x) - f.mean) @ f.projection[:, f.usable]

    if not fitted:
        return {}
    parts = _partials(rows.where(F.size("vec").isin([w for w, f in fitted.items() if f.usable.any()])), prepare)
    counts = _counts(parts)
    added = parts.select("width", (F.transform("mean", lambda x: x * F.col("n"))).alias("total"))
    means = {w: np.array(total) / counts[w] for w, total in _added(added, "total").items()}
    found = {w: float(np.abs(c - np.eye(len(c))).max()) for w, c in _covariances(parts, counts, means).items()}
    return {w: found.get(w, 0.0) for w in fitted}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - S)^2 for each row of integers."""
    top = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if top < 1 << 62:
        gap = n * x - np.array(sums, dtype=np.int64)
        if len(sums) * int(np.abs(gap).max()) ** 2 < 1 << 63:
            return (gap * gap).sum(axis=1).tolist()
    else:
        gap = n * x.astype(object) - np.array(sums, dtype=object)
    gap = gap.astype(object)
    return [int(s) for s in (gap * gap).sum(axis=1)]


def whiten(df: DataFrame, wanted: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each row and component up to ``wanted``.

    Rows whose vector is null or empty or holds null or non-finite entries are left out; vectors of different lengths
    are fitted apart, repeated rows count as often as they occur.  Entries become integers (``as_integers``), their sums and deviations
    are exact; a deviation beyond 38 digits is null.  A component without variance (all vectors alike, or fewer vectors than dimensions) has a null
    ``whitened`` and explains 0.  Vectors with fewer dimensions than ``wanted`` have as many components.  A row without an id stays; an empty table gives
    no rows; other columns of any name are not looked at.  Each pass is narrow and reads all vectors: one to fit, one for ``identity_error``, one for
    the result.  What tasks receive is mean and components of each vector length, refused beyond ``MAX_BROADCAST_BYTES``.
    """
    rows = vectors_of(df, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    fitted = fit(rows, wanted)
    if sum(f.vectors.nbytes + 16 * len(f.sums) for f in fitted.values()) > MAX_BROADCAST_BYTES:
        raise ValueError("too many different or too long vectors to broadcast their components")
    errors = identity_error(rows, fitted)
    table = {w: (f.n, f.sums, f.mean, np.nan_to_num(f.projection), f.usable, np.where(f.usable, f.values, 0.0) / (f.trace or 1.0), errors[w])
             for w, f in fitted.items()}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch, 1):
                n, sums, mean, projection, usable, explained, error = shared.value[width]
                x = as_integers(matrix(part.column(1)))
                white = (x - mean) @ projection
                count, k = white.shape
                each = np.repeat(np.arange(count), k)
                exact = [Decimal(v) if v < 10**38 else None for v in deviations(x, n, sums)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                    pa.array(np.full(count * k, n), pa.int64()), pa.array(exact, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(white.ravel(), mask=np.tile(~usable, count)), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
                                "identity_error double").withColumnRenamed("id", id_col)
