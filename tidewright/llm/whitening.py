"""Embedding whitening by the exact characteristic polynomial of an integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Components that are returned; steps of an entry; what is added to it (the scatter does not depend on it).
MOST, SCALE, SHIFT = 32, 64, 1_000_000
#: Bits behind the point of roots and of the inverse iteration; roots nearer than 2**-NEAR are one.
BITS, NEAR = 256, 96
#: Scaled entries beyond this count as this (2**56, with SHIFT still a long).
LIMIT = 1 << 56
_LIMB = 60


# --- vectors and exact sums -------------------------------------------------------------------


def scaled(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(SCALE * c) as int64 matrix) of the vectors of each length, without those that are
    null or empty or hold a null or a value that is not finite."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    ok = (size > 0) & (np.bincount(row, weights=~np.isfinite(flat), minlength=len(size)) == 0)
    start = np.cumsum(size) - size
    for d in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == d))
        values = flat[start[rows][:, None] + np.arange(d)]
        yield rows, np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64)


def gram(y: np.ndarray) -> np.ndarray:
    """The exact products of all columns of an integer matrix, as Python integers.

    Blocks of 1024 rows in limbs of 21 bits: each product of limbs is below 2**52, so that the
    floating-point matrix product is exact."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for k in range(0, len(y), 1024):
        b = y[k : k + 1024]
        if np.abs(b).max(initial=0) < 1 << 21:
            limbs = [b.astype(float)]
        else:
            limbs = [(b & 0x1FFFFF).astype(float), ((b >> 21) & 0x1FFFFF).astype(float), (b >> 42).astype(float)]
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) << 21 * (i + j)
    return total


def scatter(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums S, sums of products Q) of the scaled ``vectors`` of the commonest length (of two, the
    longer), as Python integers. Each task adds up its rows; Spark adds up the tasks by matrix entry,
    and the driver sees the entries of the matrix alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # by length: Q bordered by S and n
        for b in batches:
            for _, y in scaled(b.column("vector")):
                d = y.shape[1]
                one = np.zeros((d + 1, d + 1), object)
                one[:d, :d], one[d, :d], one[d, d] = gram(y), y.sum(0, dtype=object), len(y)
                sums[d] = sums[d] + one if d in sums else one
        for d, m in sums.items():
            i, j = np.tril_indices(d + 1)
            values = m[i, j].tolist()
            low = (1 << _LIMB) - 1
            parts = [[v & low for v in values], [v >> _LIMB & low for v in values], [v >> 2 * _LIMB for v in values]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], names=["d", "i", "j", "v0", "v1", "v2"])

    parts = vectors.mapInArrow(run, "d int, i int, j int, v0 bigint, v1 bigint, v2 bigint")
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = cut(parts.groupBy("d", "i", "j").agg(big("v0"), big("v1"), big("v2")))
    best = sums.filter("i = d and j = d").orderBy(F.desc("v0"), F.desc("d")).first()
    if best is None:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    d = best["d"]
    m = np.zeros((d + 1, d + 1), object)
    for r in sums.filter(F.col("d") == d).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = int(r["v0"]) + (int(r["v1"]) << _LIMB) + (int(r["v2"]) << 2 * _LIMB)
    return m[d, d], m[d, :d], m[:d, :d]


# --- characteristic polynomial ----------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller and Rabin; the four bases decide all n below 3 215 031 751."""
    if n < 8 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    s = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, (n - 1) >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bits: float) -> list[int]:
    """The largest primes below 2**31 whose product has ``bits`` bits or more."""
    out, have, p = [], 0.0, (1 << 31) + 1
    while have < bits:
        p -= 2
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo the prime ``p`` < 2**31: similar to an
    upper Hessenberg matrix by elimination, whose polynomial follows from its leading minors."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        m = k + int(below[0])
        if m != k:
            a[[k, m]] = a[[m, k]]
            a[:, [k, m]] = a[:, [m, k]]
        f = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - f[:, None] * a[k][None, :]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * f[None, :] % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        row = (row - int(a[k - 1, k - 1]) * minors[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(a[i, i - 1]) % p
            if not chain:
                break
            row = (row - int(a[i - 1, k - 1]) * chain % p * minors[i - 1]) % p
        minors[k] = row
    return minors[d]


def lifted(residues: dict[int, list[int]]) -> list[int]:
    """Chinese remaindering: the integers nearest to 0 with these residues for each prime."""
    whole = math.prod(residues)
    out = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        out = [x + v * unit for x, v in zip(out, values, strict=True)]
    out = [x % whole for x in out]
    return [x - whole if 2 * x > whole else x for x in out]


def charpoly(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """det(x - matrix) of a positive semidefinite integer matrix, exactly; one Spark row for each prime.

    Coefficient k from the top is the k-th symmetric function of the eigenvalues, at most
    binomial(d, k) * (trace / d)**k; the primes' product exceeds twice the largest of these."""
    d, trace = len(matrix), max(int(matrix.trace()), 1)
    bound = max(math.log2(math.comb(d, k)) + k * (math.log2(trace) - math.log2(d)) for k in range(d + 1))
    moduli = primes(max(bound, 0) + 8)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array([charpoly_mod(shared.value, x).tolist() for x in p], pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.createDataFrame([(p,) for p in moduli], "p bigint").mapInArrow(run, "p bigint, c array<bigint>").collect()
    return lifted({r["p"]: r["c"] for r in rows})


# --- roots and components ---------------------------------------------------------------------


def above(poly: list[int], num: int, bits: int) -> int:
    """How many roots of ``poly``, all real, exceed num / 2**bits: the sign changes of the polynomial
    moved there (Descartes' rule is exact where all roots are real)."""
    d = len(poly) - 1
    c = np.array([x << bits * (d - i) for i, x in enumerate(poly)], object)[::-1].copy()
    for k in range(d):  # Taylor shift: prefix sums of x + num, one row shorter each time
        for i in range(1, d + 1 - k):
            c[i] += num * c[i - 1]
    signs = [x > 0 for x in c.tolist() if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive(poly: list[int], num: int, bits: int) -> int:
    """The sign of ``poly`` at num / 2**bits."""
    acc = 0
    for k, c in enumerate(reversed(poly)):
        acc = acc * num + (c << bits * k)
    return (acc > 0) - (acc < 0)


def root(poly: list[int], k: int, top: int) -> tuple[int, int, int]:
    """The k-th greatest root (from 0) of ``poly``, whose roots are all real and in (0, top): its value
    times 2**BITS rounded down, and the first and the number of the roots that are one with it.

    Halving by counts until the root is alone, then by the sign of the polynomial. Roots that are not
    apart by 2**-NEAR count as one of several."""
    lo, hi, bits = 0, 1 << max(top, 1).bit_length(), 0
    over_lo, over_hi = above(poly, 0, 0), 0
    while over_lo - over_hi > 1 and bits < NEAR:
        if hi - lo == 1:
            lo, hi, bits = lo << 16, hi << 16, bits + 16
        mid = (lo + hi) // 2
        n = above(poly, mid, bits)
        if n > k:
            lo, over_lo = mid, n
        else:
            hi, over_hi = mid, n
    lo, hi = lo << BITS - bits, hi << BITS - bits
    if over_lo - over_hi == 1:
        right = positive(poly, hi, BITS)
        if right == 0:
            return hi, over_hi, 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            s = positive(poly, mid, BITS)
            if s == 0:
                return mid, over_hi, 1
            lo, hi = (lo, mid) if s == right else (mid, hi)
    return (lo + hi) // 2, over_hi, over_lo - over_hi


def null_vectors(matrix: np.ndarray, value: int, m: int) -> np.ndarray:
    """``m`` orthonormal rows that matrix - value / 2**BITS takes to (nearly) nothing.

    Inverse iteration in fixed point with BITS bits behind the point: an LU decomposition with row
    exchanges whose last pivots nearly vanish, and two solves for each of m fixed starting vectors.
    """
    d = len(matrix)
    a = np.array([[int(x) << BITS for x in r] for r in matrix], object)
    a[np.arange(d), np.arange(d)] -= value
    order = np.arange(d)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if best != k:
            a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            f = (a[k + 1 :, k] << BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :][None, :]) >> BITS
            a[k + 1 :, k] = f

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(1, d):
            y[k] -= int((a[k, :k] * y[:k]).sum()) >> BITS
        for k in range(d - 1, -1, -1):
            rest = int((a[k, k + 1 :] * y[k + 1 :]).sum()) >> BITS if k + 1 < d else 0
            y[k] = ((y[k] - rest) << BITS) // a[k, k]
        most = max(abs(x) for x in y)
        return np.array([(x << BITS) // most for x in y], object)

    random, basis = np.random.default_rng(12), []
    for _ in range(m):
        v = np.array([int(x) << BITS - 40 for x in random.integers(-(1 << 40), 1 << 40, d)], object)
        for _ in range(2):
            v = solve(v)
            for b in basis:
                v = v - (b * (int((v * b).sum()) >> BITS) >> BITS)
        length = math.isqrt(int((v * v).sum()))
        basis.append(np.array([(x << BITS) // length for x in v], object))
    return np.array([[x / (1 << BITS) for x in b] for b in basis])


@dataclass(frozen=True)
class Whitening:
    """n vectors were fitted; ``sums`` of their scaled entries; a row of ``components`` for each of the
    eigenvalues ``values`` of their covariance, the greatest first; the share ``explained`` of each."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    explained: np.ndarray
    components: np.ndarray

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n of scaled vectors, and the exact sum of (n*x - S)**2 of each, as Python integers
        where they exceed 64 bits."""
        most = self.n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        wide = most * most * max(len(self.sums), 1) >= 1 << 63
        apart = y.astype(object if wide else np.int64) * self.n - np.array(self.sums, object if wide else np.int64)
        x = np.array([[v / self.n for v in r] for r in apart], float).reshape(y.shape) if wide else apart / self.n
        return x, (apart * apart).sum(1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return x @ self.components.T / np.sqrt(self.values)


def fit(vectors: DataFrame, most: int = MOST) -> Whitening:
    """Fit a whitening to the column ``vector``: the exact scatter matrix M = n*Q - S*S' of the scaled
    entries, its exact characteristic polynomial, and for each of the ``most`` greatest eigenvalues
    that are not 0 one Spark row that isolates its root and finds its component."""
    spark = vectors.sparkSession
    n, s, q = scatter(vectors)
    m = q * n - np.outer(s, s)
    trace = int(m.trace()) if n else 0
    poly = charpoly(spark, m) if trace else [1]
    rank = next(k for k, c in enumerate(poly) if c)  # so often 0 is a root
    poly = poly[rank:]
    k = min(most, len(poly) - 1)
    none = np.zeros(0)
    if not k:
        return Whitening(n, tuple(s), none, none, np.zeros((0, len(s))))
    shared = spark.sparkContext.broadcast((poly, m, trace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            poly, m, trace = shared.value
            values, shares, vectors = [], [], []
            for i in b.column("k").to_pylist():
                value, first, several = root(poly, i, trace)
                values.append(value / (n * n << BITS))
                shares.append(value / (trace << BITS))
                v = null_vectors(m, value, several)[i - first]
                vectors.append((v * np.sign(v[np.abs(v).argmax()])).tolist())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(values), pa.array(shares), pa.array(vectors, pa.list_(pa.float64()))], names=["k", "value", "share", "vector"])

    rows = spark.createDataFrame([(i,) for i in range(k)], "k int").mapInArrow(run, "k int, value double, share double, vector array<double>").collect()
    rows.sort(key=lambda r: r["k"])
    return Whitening(n, tuple(s), *(np.array([r[c] for r in rows]) for c in ("value", "share", "vector")))


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity.

    Each task centres its rows on their own mean before it multiplies; Spark adds up the tasks'
    products and what their means differ. 0 where there is no component."""
    k, d = len(w.values), len(w.sums)
    if not k:
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for rows, y in scaled(b.column("vector")):
                if y.shape[1] == d:
                    z = w.whitened(w.centred(y)[0])
                    m = z.mean(0)
                    step = m - mean
                    products += (z - m).T @ (z - m) + np.outer(step, step) * (n * len(rows) / (n + len(rows)))
                    mean, n = mean + step * (len(rows) / (n + len(rows))), n + len(rows)
        if n:
            full = np.zeros((k + 1, k + 1))
            full[:k, :k], full[k, :k] = products + n * np.outer(mean, mean), n * mean
            i, j = np.tril_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(full[i, j])], names=["i", "j", "v"])

    full = np.zeros((k + 1, k + 1))
    for r in vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["v"]
    mean = full[k, :k] / w.n
    return float(np.abs(full[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, deviation (decimal, null beyond 38 digits) and whitened (an array, a value for each component) of every row with a usable vector; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    src = rows.select(rows[id_column].alias("id"), rows[vector_column].alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            for at, y in scaled(b.column("vector")):
                if y.shape[1] == len(w.sums):
                    x, far = w.centred(y)
                    z = w.whitened(x)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), z.shape[1]).cast(pa.list_(pa.float64())) if z.size else pa.array([[]] * len(at), pa.list_(pa.float64()))
                    digits = pa.array([str(v) if v < 10**38 else None for v in far.tolist()])
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), digits.cast(pa.decimal128(38, 0)), lists], names=["id", "deviation", "whitened"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_column)


def whitening(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = MOST) -> DataFrame:
    """A row per usable vector and component: id, component (from 1), n, deviation (long), whitened,
    explained, identity_error.

    An entry c counts as floor(64 * c) + 1 000 000; components, eigenvalues and deviations are those
    of these integers and exact up to their last rounding to a double. Vectors that are null or
    empty, or hold a null or a value that is not finite, are dropped, as are those of another
    length than the commonest (of two, the longer). Directions without variance are no component,
    so equal vectors, a single one or an empty table give no rows. Repeated rows and ids count as
    often as they stand there; null ids stay; equal eigenvalues have any orthonormal components, the
    same for all rows. A deviation beyond a long is null (``whiten`` has it as a decimal). Other
    columns are ignored. The table is read three times and nothing of it is shuffled but matrix
    entries; driver and tasks hold a few matrices of the dimension.
    """
    vectors = rows.select(rows[vector_column].alias("vector"))
    w = fit(vectors, most)
    error = identity_error(vectors, w)
    shares = F.array(*[F.lit(float(x)) for x in w.explained]).cast("array<double>")
    out = whiten(rows, w, id_column, vector_column)
    out = out.select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        id_column, (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings``, whitened."""
    return whitening(table(spark, sf_dir, "embeddings"))
