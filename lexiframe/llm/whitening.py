"""Whitening of embeddings on their leading components, found by Jacobi-Davidson.

The covariance is never formed: every product with it is a pass over the distinct vectors, which
are centred before they multiply, a block of right-hand sides at a time, and only a matrix as wide
as the block comes back. On the driver are a small orthonormal subspace and its products. Each
round takes the Ritz pairs of the subspace (Rayleigh-Ritz), locks the leading ones whose residuals
are at double precision, and widens the subspace by the solutions of the projected correction
equations of the others, solved by a few steps of MINRES for all of them together.

Entries are whole numbers, so sums are exact and a vector is centred without loss: n*x - S in whole
numbers, divided by n once.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.common import ship
from lexiframe.plans.layout import written

SCALE = 64.0
FARTHEST = float(1 << 40)  # entries beyond count as not finite
BLOCK_CELLS = 1 << 18
TOLERANCE = 64 * float(np.finfo("f8").eps)  # of the largest eigenvalue: what rounding leaves of a residual


@dataclass
class Whitened:
    """`rows`: vec_id, `deviation` and `whitened` (one value per component) of every usable row."""

    rows: DataFrame
    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]
    identity_error: float


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and `y`, floor(64 * entry) of each vector that holds finite entries only, and the
    width. Of several widths the most frequent one counts (the larger among equals), and vectors of
    other widths are left out like those that hold nulls."""
    cells = F.transform(vector, lambda c: c.cast("double"))
    rows = df.select(F.col(key).alias("vec_id"), cells.alias("cells")).filter(
        F.coalesce(F.forall("cells", lambda c: c.isNotNull() & (F.abs(c) <= FARTHEST)), F.lit(False)))
    most = rows.groupBy(F.size("cells").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("cells", F.abs))).alias("peak")).orderBy(
        F.desc("n"), F.desc("width")).first()
    width, peak = (most["width"], most["peak"] or 0) if most else (0, 0)
    kind = "int" if peak < (1 << 24) else "long"
    whole = F.transform("cells", lambda c: F.floor(c * SCALE).cast(kind))
    return rows.filter(F.size("cells") == width).select("vec_id", whole.alias("y")), width


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """The distinct vectors as blocks: `kind` and the bytes of a matrix with a row per vector."""
    kind = "<i4" if rows.schema["y"].dataType == T.ArrayType(T.IntegerType()) else "<i8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, BLOCK_CELLS // max(1, width))
        for batch in batches:
            if len(batch):
                y = np.stack(batch["y"].to_numpy()).astype(kind)
                yield pd.DataFrame({"block": [y[k:k + most].tobytes() for k in range(0, len(y), most)]})

    blocks = rows.select("y").distinct().mapInPandas(run, "block binary")
    return written(blocks.withColumn("kind", F.lit(kind)), "fit_list")


def total(blocks: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray], kind: str = "f8") -> np.ndarray | None:
    """The sum of `make` over all blocks: summed in each task, then in groups of about the square
    root of the tasks, then here. Doubles carry what rounding drops, so long sums stay exact to
    double precision; whole numbers are added as such."""
    exact = kind == "f8"

    def add(pair, more, error=None):
        if pair is None:
            return more, (np.zeros_like(more) if error is None else error)
        if not exact:
            return pair[0] + more, pair[1]
        high = pair[0] + more
        part = high - pair[0]
        low = pair[1] + ((pair[0] - (high - part)) + (more - part))
        return high, low if error is None else low + error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = None
        for batch in batches:
            for name, raw in zip(batch["kind"], batch["block"]):
                pair = add(pair, make(np.frombuffer(raw, name).reshape(-1, width)))
        if pair is not None:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [np.stack(pair).tobytes()]})

    def merged(rows: pd.DataFrame):
        pair = None
        for raw in rows.sort_values("task")["sums"]:
            high, low = np.frombuffer(raw, kind).reshape(2, -1)
            pair = add(pair, high, low)
        return pair

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [int(group["task"].min())], "sums": [np.stack(merged(group)).tobytes()]})

    sums = blocks.mapInPandas(run, "task long, sums binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 256:
        groups = isqrt(tasks)
        sums = sums.groupBy(F.col("task") % groups).applyInPandas(gather, "task long, sums binary")
    pair = merged(sums.toPandas())
    return None if pair is None else pair[0] + pair[1]


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of `new` add to the orthonormal `against`."""
    basis = np.concatenate(against, axis=1) if against else np.zeros((len(new), 0))
    out = np.zeros((len(new), 0))
    for column in new.T:
        length = np.linalg.norm(column)
        if not length > 0:
            continue
        column = column / length
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            out = np.column_stack([out, column])
    return out[:, :len(new) - basis.shape[1]]


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, basis: np.ndarray,
           wanted: np.ndarray, steps: int, reduce: float = 0.05) -> np.ndarray:
    """A few steps of MINRES for (I - QQ')(V - shift)(I - QQ') t = wanted, one shift a column; every
    step is one product for all columns."""
    def project(x):
        return x - basis @ (basis.T @ x)

    t = np.zeros_like(wanted)
    v = project(wanted)
    beta = np.linalg.norm(v, axis=0)
    goal, rest = reduce * beta, beta.copy()
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    v, old = v / safe(beta), np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta = beta.copy()
    last = np.zeros_like(beta)
    for _ in range(steps):
        if (rest <= goal).all():
            break
        u = project(product(v) - v * shifts)
        alpha = (v * u).sum(0)
        u = project(u - v * alpha - old * last)
        following = np.linalg.norm(u, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before
        diagonal = c * alpha - c_old * s * last
        length = np.hypot(diagonal, following)
        above = s * alpha + c_old * c * last
        far = s_old * last
        c_old, s_old = c, s
        c, s = diagonal / safe(length), following / safe(length)
        w, w_old = (v - w * above - w_old * far) / safe(length), w
        t = t + w * (c * eta) * (length > 0)
        rest = np.abs(s) * rest
        eta = -s * eta
        old, v, last = v, u / safe(following), following
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, most: int,
                    steps: int = 4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix given
    by its products. All residuals end at double precision of the largest eigenvalue."""
    most = min(most, width)
    locked, values = np.zeros((width, 0)), []
    space = orthonormal(np.random.default_rng(11).standard_normal((width, min(width, most + 4))))
    image = product(space)
    widest = max(6 * most, 96)
    for turns in range(rounds):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        need = min(most - len(values), len(ritz))
        residual = image[:, :need] - space[:, :need] * ritz[:need]
        sizes = np.linalg.norm(residual - locked @ (locked.T @ residual), axis=0)
        scale = max([abs(ritz[0]), *np.abs(values[:1])])
        full = locked.shape[1] + space.shape[1] == width  # nothing is left to widen by
        done = need if full else int((sizes <= TOLERANCE * scale).cumprod().sum())
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            values += ritz[:done].tolist()
            space, image, residual = space[:, done:], image[:, done:], residual[:, done:]
            ritz, need = ritz[done:], need - done
        if len(values) == most:
            return np.array(values), locked
        if min(space.shape[1] + need, width - locked.shape[1]) > widest:  # restart on the leading Ritz vectors
            space, image = space[:, :need + most], image[:, :need + most]
        held = np.column_stack([locked, space[:, :need]])
        new = minres(product, ritz[:need], held, -residual, steps)
        new = orthonormal(new, locked, space)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(turns).standard_normal((width, need)), locked, space)
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError("residuals do not reach double precision")


def whiten(df: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> Whitened:
    """Whitened values of every usable row on the leading components of the distinct vectors.

    An entry c counts as floor(64 * c). Rows whose vector is null or empty or holds null or
    non-finite entries (or entries beyond 2^40) are left out; so are vectors that are not of the
    most frequent width. Equal vectors are fitted once, however many rows hold them, and each row
    keeps its values. Components without variance (below double precision of the largest) are not
    returned, so a single distinct vector, or none, has no component, and an empty table no rows.
    Equal eigenvalues leave their components free to turn; all rows share one choice. `deviation`
    is the exact sum over dimensions of (n*x - S)^2, null where a long cannot hold it. Other
    columns are ignored, whatever their names. A null id stays null.
    """
    ship(df.sparkSession)
    rows, width = usable(df, key, vector)
    blocks = fit_list(rows, width)
    # entries are kept without the offset of the whole numbers asked for, which centring takes out
    # again: an offset the same in every vector changes neither n*x - S nor the covariance
    counted = total(blocks, width, lambda y: np.append(y.sum(0, dtype="i8"), len(y)), "i8") if width else None
    if counted is None:
        return Whitened(_scored(rows, 0, np.zeros(0, "i8"), np.zeros((0, 0)), None), 0, [], [], np.zeros((0, 0)), [], 0.0)
    n, sums = int(counted[-1]), counted[:-1]

    def centred(y: np.ndarray) -> np.ndarray:
        return (n * y.astype("i8") - sums) / n

    def product(w: np.ndarray) -> np.ndarray:
        def make(y: np.ndarray) -> np.ndarray:
            c = centred(y)
            return (c.T @ (c @ w)).ravel()

        return total(blocks, width, make).reshape(w.shape) / n

    values, vectors = jacobi_davidson(product, width, components)
    kept = values > TOLERANCE * max(values[0], 0.0)
    values, vectors = values[kept], vectors[:, kept]
    scaled = vectors / np.sqrt(values)

    def check(y: np.ndarray) -> np.ndarray:
        c = centred(y)
        w = c @ scaled
        return np.append((w.T @ w).ravel(), (c * c).sum())

    seen = total(blocks, width, check) / n
    error = np.abs(seen[:-1].reshape(len(values), len(values)) - np.eye(len(values))).max(initial=0.0)
    trace = float(seen[-1])
    offset = 1_000_000 * n
    return Whitened(_scored(rows, n, sums, scaled, rows.schema), n, [int(s) + offset for s in sums], values.tolist(),
                    vectors, (values / trace).tolist() if trace > 0 else [], float(error))


def _scored(rows: DataFrame, n: int, sums: np.ndarray, scaled: np.ndarray, schema) -> DataFrame:
    key = T.StructField("vec_id", rows.schema["vec_id"].dataType)
    schema = T.StructType([key, *T._parse_datatype_string("deviation long, whitened array<double>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            z = n * np.stack(batch["y"].to_numpy()).astype("i8") - sums
            rough = (z.astype("f8") ** 2).sum(1)
            exact = pd.array((z * z).sum(1), "Int64")
            exact[rough >= 2.0 ** 63 * 0.999] = pd.NA
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": exact,
                                "whitened": list(z / n @ scaled)})

    return rows.mapInPandas(run, schema)
