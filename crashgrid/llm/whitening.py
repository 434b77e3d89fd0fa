"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(1024 c) + 100000. With X the rows minus their means,
the bidiagonalisation builds orthonormal v_j (as long as a vector) and u_j (as long as the
table) with X v_j = beta u_(j-1) + alpha u_j. No u_j is stored: all lie in the range of X, so
each is kept as its short coefficient vector p_j with u_j = X p_j, and a task forms its part
of the u_j from its rows. One pass over the rows gives the product u = X q, its overlaps
with all earlier u_j, and the product X'u; the driver subtracts the overlaps (a second pass
follows where they were not small), orthogonalises against all v_j, and extends the
bidiagonal matrix, whose singular value decomposition yields components and deviations. It
stops when the residuals of the wanted components vanish, at the latest after as many steps
as there are dimensions.

What comes to the driver is one number per dimension and step, added up by Spark before.
Rows are stored as blocks of numbers in the shared folder, so a lost task reads its block
again.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Where
lengths differ, the most frequent length (the larger of equals) is kept and rows of other
lengths are dropped. x saturates at the limits of a long. Rows with equal or null ids are
rows of their own. Components whose variance is below rounding are not returned, so equal
vectors, one row or an empty table give no rows. A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.texts import read
from crashgrid.sources.storage import materialise

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
BLOCK_BYTES = 4 << 20
#: Residual, and overlap that asks for a second pass, in units of the largest singular value.
RESIDUAL, OVERLAP = 1e-15, 1e-10
#: Variance below this share of all is rounding.
NOTHING = 1e-20

_LONG = 2**63
#: Whole numbers up to here may be added a million times in 64 bits.
_SAFE = 2**42


@dataclass
class Whitening:
    """Means as exact sums, components as columns, and variances along them."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    steps: int

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def number_blocks(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``length, n, ids, x``: blocks of vectors of one length; ``x`` are 64-bit numbers, row by row."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            at = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
            odd = np.r_[0, np.cumsum(~np.isfinite(entries))]
            lengths = np.where(odd[at[1:]] == odd[at[:-1]], np.diff(at), 0)
            for length in np.unique(lengths[lengths > 0]):
                chosen = np.flatnonzero(lengths == length)
                step = max(1, BLOCK_BYTES // (8 * int(length)))
                for first in range(0, len(chosen), step):
                    some = chosen[first : first + step]
                    found = np.floor(SCALE * entries[at[some][:, None] + np.arange(length)]) + SHIFT
                    x = np.where(np.abs(found) < _LONG, found, 0).astype(np.int64)
                    x[found >= _LONG], x[found <= -_LONG] = _LONG - 1, -_LONG
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column("vec_id").take(pa.array(some)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([length], pa.int32()), pa.array([len(some)]), ids, pa.array([x.astype("<i8").tobytes()], pa.binary())],
                        ["length", "n", "ids", "x"],
                    )

    return rows.mapInArrow(run, f"length int, n long, ids array<{id_type}>, x binary")


def _matrices(batches, length: int):
    for batch in batches:
        for body in batch.column("x"):
            yield np.frombuffer(body.as_py(), "<i8").reshape(-1, length)


def _column_sums(blocks: DataFrame, length: int) -> list[int]:
    def run(batches):
        total = np.zeros(length, object)
        for x in _matrices(batches, length):
            total = total + _exact(x).sum(axis=0)
        whole = pa.array(total.tolist(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), whole], ["at", "total"])

    sums = blocks.select("x").mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    return [int(r.total) for r in sorted(sums.collect())]


def _exact(x: np.ndarray) -> np.ndarray:
    """Numbers whose sums and small multiples cannot overflow."""
    return x if len(x) == 0 or np.abs(x.astype(float)).max() < _SAFE else x.astype(object)


def _summed(blocks: DataFrame, length: int, size: int, of_block) -> np.ndarray:
    """The sum of ``of_block(x)``, an array of ``size`` doubles, over all blocks."""

    def run(batches):
        total = np.zeros(size)
        for x in _matrices(batches, length):
            total += of_block(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "total"])

    found = blocks.select("x").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    return np.array([r.total for r in sorted(found.collect())])


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the most frequent length in ``blocks`` (written ``number_blocks``)."""
    largest = blocks.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if largest is None:
        return None
    length, n = largest.length, largest.n
    blocks = blocks.where(F.col("length") == length)
    sums = _column_sums(blocks, length)
    means = np.array([s / n for s in sums])
    total = float(_summed(blocks, length, 1, lambda x: np.square(x - means).sum()[None])[0])
    model = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), total / n, 0)
    if total <= NOTHING * n * max(1.0, float(np.square(means).sum())):
        return model
    scale = total**0.5

    def product(q: np.ndarray, left: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Length of u = X q, overlaps with the columns of X ``left``, and X'u."""

        def of_block(x):
            centred = x - means
            u = centred @ q
            return np.r_[u @ u, (u @ centred) @ left, u @ centred] if left.shape[1] else np.r_[u @ u, u @ centred]

        found = _summed(blocks, length, 1 + left.shape[1] + length, of_block)
        return float(found[0]), found[1 : 1 + left.shape[1]], found[1 + left.shape[1] :]

    random = np.random.default_rng(5)
    right = np.zeros((length, 0))  # v_j
    left = np.zeros((length, 0))  # p_j, with u_j = X p_j
    back = np.zeros((length, 0))  # X'u_j
    alphas, betas = [], []
    v = _fresh(right, random)
    q = v
    for step in range(1, length + 1):
        right = np.column_stack([right, v])
        squared, overlap, xu = product(q, left)
        q, xu = q - left @ overlap, xu - back @ overlap
        if np.abs(overlap).max(initial=0) > OVERLAP * max(squared, 0) ** 0.5:
            squared, overlap, xu = product(q, left)
            q, xu = q - left @ overlap, xu - back @ overlap
        alpha = max(squared - float(overlap @ overlap), 0.0) ** 0.5
        if alpha <= NOTHING**0.5 * scale:
            alpha, q, xu = 0.0, np.zeros(length), np.zeros(length)
        else:
            q, xu = q / alpha, xu / alpha
        left, back = np.column_stack([left, q]), np.column_stack([back, xu])
        alphas.append(alpha)
        w = xu
        for _ in range(2):
            w = w - right @ (right.T @ w)
        beta = float(np.linalg.norm(w))
        small = np.diag(alphas) + np.diag(betas, 1)
        a, values, z = np.linalg.svd(small)
        wanted = min(components, step)
        open_ends = np.abs(beta * a[-1, :wanted]).max() > RESIDUAL * values[0]
        if step == length or (step >= min(components, length) and beta > NOTHING**0.5 * scale and not open_ends):
            break
        if beta <= NOTHING**0.5 * scale:  # an invariant space: go on outside of it
            beta, v = 0.0, _fresh(right, random)
        else:
            v = w / beta
        betas.append(beta)
        q = v - beta * left[:, -1]
    found = min(components, int(np.sum(np.square(values) > NOTHING * total)))
    vectors = right @ z.T[:, :found]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(found)]) if found else np.ones(0)
    return Whitening(n, sums, vectors * signs, np.square(values[:found]) / n, total / n, step)


def _fresh(right: np.ndarray, random: np.random.Generator) -> np.ndarray:
    v = random.standard_normal(len(right))
    for _ in range(2):
        v = v - right @ (right.T @ v)
        v /= np.linalg.norm(v)
    return v


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity."""
    k, means, turn = model.components.shape[1], model.means, model.components / np.sqrt(model.variances)

    def of_block(x):
        y = (x - means) @ turn
        return np.r_[(y.T @ y).ravel(), y.sum(axis=0)]

    length = len(means)
    found = _summed(blocks.where(F.col("length") == length), length, k * k + k, of_block) / model.n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def transform(blocks: DataFrame, model: Whitening, block_error: float) -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    element = blocks.schema["ids"].dataType.elementType.simpleString()
    n, sums, means, k = model.n, model.sums, model.means, model.components.shape[1]
    turn = model.components / np.sqrt(model.variances)
    share = model.variances / model.total_variance
    length = len(sums)
    exact_sums = np.array(sums, object)
    widest = max((abs(s) for s in sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        bound = n * float(np.abs(x.astype(float)).max()) + widest
        if bound < 2**62 and length * float(np.abs(n * (x - means)).max() + 1) ** 2 < 2**62:
            return np.square(n * x - exact_sums.astype(np.int64)).sum(axis=1).tolist()
        found = np.square(n * x.astype(object) - exact_sums).sum(axis=1)
        return [int(f) if f < _LONG else None for f in found]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[row].as_py(), "<i8").reshape(-1, length)
                ids = batch.column("ids")[row].values
                size = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(((x - means) @ turn).ravel()),
                        pa.array(np.tile(share, size)),
                        pa.array(np.full(size * k, block_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"vec_id {element}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return blocks.where(F.col("length") == length).select("ids", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all vectors and transform them; see ``transform`` for the columns."""
    blocks = materialise(number_blocks(vectors, vec_id, vector), "vectors")
    model = fit(blocks, components)
    if model is None or not len(model.variances):
        empty = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), 1.0, 0)
        return transform(blocks.where("false"), empty, 0.0)
    return transform(blocks, model, identity_error(blocks, model))


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
