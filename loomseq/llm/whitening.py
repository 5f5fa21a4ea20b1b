"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Spark folds copies, adds up sums and the centred scatter, whose size is that of the dimension and not of the input,
and projects every row; the driver factors one matrix of dimension x dimension.  Sums and scatter are of whole
numbers and exact, so they do not depend on the order in which Spark adds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomseq.llm.common import cut, keyed

SCALE, COMPONENTS = 64, 16
#: Entries are held to this many steps either way, so that whole numbers stay exact in double precision.
FARTHEST = 1 << 50
_EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(batch: pa.RecordBatch, d: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * entry) as int64."""
    entries = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * entries), -FARTHEST, FARTHEST).astype(np.int64).reshape(-1, d)


def unpacked(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, d)


def gram(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers, exactly: double precision in blocks whose sums it holds, else Python's integers."""
    most = int(np.abs(x).max(initial=0))
    rows = _EXACT // max(1, most * most)
    if not rows:
        wide = x.astype(object)
        return wide.T @ wide
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    f = x.astype(np.float64)
    for s in range(0, len(f), rows):
        b = f[s : s + rows]
        total = total + (b.T @ b).astype(np.int64)
    return total


def add_up(table: DataFrame, part, names: tuple[str, ...], kind: str) -> list:
    """Sums of what ``part`` (an iterator of Arrow batches -> rows of indices and a number) gives per task."""
    schema = ", ".join(f"{n} int" for n in names) + ", n string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(part(batches))
        if rows:
            *index, number = zip(*rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(i, pa.int32()) for i in index), pa.array([str(v) for v in number])], schema=arrow)

    return table.mapInArrow(run, schema).groupBy(*names).agg(F.sum(F.col("n").cast(kind)).alias("n")).collect()


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """The factor g (columns in the order of the pivots) with g g' = a; it ends where the rest is rounding."""
    rest, columns = a.copy(), []
    least = len(a) * np.finfo(float).eps * max(float(np.diag(a).max(initial=0)), 0.0)
    done: list[int] = []
    for _ in range(len(a)):
        p = int(np.diag(rest).argmax())
        if not rest[p, p] > least:
            break
        c = rest[:, p] / np.sqrt(rest[p, p])
        c[done] = 0.0
        rest -= np.outer(c, c)
        done.append(p)
        rest[done, done] = -1.0
        columns.append(c)
    return np.array(columns).T.reshape(len(a), -1)


def jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of g g': columns of g are rotated until all are orthogonal."""
    cols = np.array(g.T, order="C")
    turned = True
    while turned:
        turned = False
        for p in range(len(cols) - 1):
            for q in range(p + 1, len(cols)):
                a, b, c = cols[p] @ cols[p], cols[q] @ cols[q], cols[p] @ cols[q]
                if abs(c) <= 4 * np.finfo(float).eps * np.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * c)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.sqrt(1 + z * z))
                cos = 1 / np.sqrt(1 + t * t)
                cols[p], cols[q] = cos * cols[p] - cos * t * cols[q], cos * t * cols[p] + cos * cols[q]
    norms = np.sqrt((cols * cols).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (cols[order] / norms[order, None]).T


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Principal components of ``vector``, whitened: one row per kept row and component.

    Columns: ``key``, component (from 1, by falling eigenvalue), n, deviation (decimal: sum over dimensions of (n*x - S)^2,
    exact), whitened, explained, identity_error.  x = floor(scale * entry); a constant added to all x would change nothing.
    The fit list is each different x once, n and S are its length and its sums per dimension; every covariance is over
    it, with divisor n.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out; of vectors of several lengths those
    of the most frequent one stay (of equally frequent ones the longest).  Steps beyond 2**50 are held there.  Repeated
    ids and null ids are rows like any other.  Components without variance are not given: vectors of rank r have
    at most r, one vector alone or an empty table none.  Other columns are not read.
    """
    spark = table.sparkSession
    v = F.col(f"`{vector}`")
    rows = table.where(finite(v)).select(F.col(f"`{key}`").alias("id"), v.alias("v"))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    shape = keyed(key, rows.schema["id"].dataType, "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not first:
        return spark.createDataFrame([], shape)
    d = first[0]["d"]
    rows = rows.where(F.size("v") == d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in whole(b, d, scale)], pa.binary())], names=["x"])

    fit = cut(rows.select("v").mapInArrow(pack, "x binary").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fitlist")
    n = fit.count()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total = np.zeros(d, dtype=object)
        for b in batches:
            x = unpacked(b, d)
            total = total + (x if FARTHEST * len(x) < 1 << 63 else x.astype(object)).sum(axis=0)
        yield from enumerate(total)

    s = np.array([int(r["n"]) for r in sorted(add_up(fit, sums, ("i",), "decimal(38,0)"), key=lambda r: r["i"])], dtype=object)
    # x - S/n = (x - centre) - lean/n with whole numbers x - centre and |lean| <= n/2
    centre = np.array([(2 * int(t) + n) // (2 * n) for t in s], dtype=np.int64)
    lean = [int(t) - n * int(c) for t, c in zip(s, centre)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total = np.zeros((d, d), dtype=object)
        for b in batches:
            total = total + gram(unpacked(b, d) - centre)
        yield from ((i, j, total[i, j]) for i in range(d) for j in range(i, d))

    scatter = np.zeros((d, d))
    for r in add_up(fit, products, ("i", "j"), "decimal(38,0)"):
        i, j = r["i"], r["j"]
        scatter[i, j] = scatter[j, i] = (n * int(r["n"]) - lean[i] * lean[j]) / n
    values, vectors = jacobi(pivoted_cholesky(scatter))
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], shape)
    turn = vectors[:, :k] / np.sqrt(values[:k] / n)
    explained = values[:k] / np.trace(scatter)
    part = np.array([x / n for x in lean])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        total, once = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = (unpacked(b, d) - centre - part) @ turn
            total += w.T @ w
            once += w.sum(axis=0)
        yield from ((i, j, repr(float(total[i, j]))) for i in range(k) for j in range(i, k))
        yield from ((i, -1, repr(float(once[i]))) for i in range(k))

    found = {(r["i"], r["j"]): r["n"] / n for r in add_up(fit, squares, ("i", "j"), "double")}
    error = max(abs(m - found[i, -1] * found[j, -1] - (i == j)) for (i, j), m in found.items() if j >= 0)
    leans, rest = np.array(lean, dtype=object), sum(x * x for x in lean)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(shape)
        for b in batches:
            x = whole(b, d, scale) - centre
            w = ((x - part) @ turn).ravel()
            wide = x.astype(object)
            a, c = (x * x).sum(axis=1) if int(np.abs(x).max(initial=0)) ** 2 * d < 1 << 63 else (wide * wide).sum(axis=1), x @ leans.astype(np.int64) if n * int(np.abs(x).max(initial=0)) * d < 1 << 63 else wide @ leans
            far = pa.array([Decimal(n * n * int(p) - 2 * n * int(q) + rest) for p, q in zip(a, c)], pa.decimal128(38, 0))
            each, many = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n, dtype=np.int64)), far.take(pa.array(each)),
                pa.array(w), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, float(error))),
            ], schema=arrow)

    return rows.mapInArrow(project, shape)


def whiten_digest(table: DataFrame) -> DataFrame:
    """``whiten`` with deviation as long; one that no long holds (n over some millions) is null there."""
    return whiten(table).withColumn("deviation", F.col("deviation").try_cast("long"))
