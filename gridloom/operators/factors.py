"""Principal components and factors. Moments are Spark aggregates; what is left for the driver is variables by variables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_moments(rows: DataFrame, vec: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the mean and the covariance (of a sample) of a column of vectors of one length.

    Partitions add up their products by themselves and send one matrix each, as one row.
    """

    def add_up(batches):
        import pyarrow as pa

        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, dim)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "ss"])

    parts = rows.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.transform(vec, lambda v: v.cast("double")).alias("x")).mapInArrow(add_up, "n long, s array<double>, ss array<double>")
    total = parts.select("n", F.posexplode(F.concat("s", "ss")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("k").collect()  # dim + dim x dim numbers
    n, v = int(total[0].n), np.array([r.v for r in total])
    s, ss = v[:dim], v[dim:].reshape(dim, dim)
    return n, s / max(n, 1), (ss - np.outer(s, s) / max(n, 1)) / max(n - 1, 1)


def correlation_matrix(edges: DataFrame, names: list[str]) -> np.ndarray:
    """The matrix of an edge list (a, b, r)."""
    at = {c: i for i, c in enumerate(names)}
    out = np.eye(len(names))
    for e in edges.collect():
        out[at[e.a], at[e.b]] = e.r
    return out


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(largest < 0, -1.0, 1.0)


def principal(matrix: np.ndarray, m: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = np.maximum(values[::-1], 0.0)[:m], vectors[:, ::-1][:, :m]
    return values, signed(vectors)


def nearest_positive(matrix: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Eigenvalues raised to ``least`` and the diagonal brought back to 1."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    out = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d)


def kept_columns(matrix: np.ndarray, names: list[str], most: float = 0.999) -> list[str]:
    """Columns in order, without those that correlate above ``most`` with one kept before."""
    kept: list[int] = []
    for i in range(len(names)):
        if not any(abs(matrix[i, j]) > most for j in kept):
            kept.append(i)
    return [names[i] for i in kept]


def most_factors(d: int) -> int:
    """The largest m with (d - m)^2 >= d + m."""
    return max((m for m in range(d + 1) if (d - m) ** 2 >= d + m), default=0)


def varimax(loadings: np.ndarray, steps: int = 100) -> np.ndarray:
    p, k = loadings.shape
    turn, was = np.eye(k), 0.0
    for _ in range(steps):
        now = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (now**3 - now * (now**2).sum(0) / p))
        turn = u @ v
        if s.sum() <= was * (1 + 1e-9):
            break
        was = s.sum()
    return loadings @ turn


def factor_analysis(matrix: np.ndarray, m: int, steps: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """Maximum-likelihood loadings of a correlation matrix by EM, turned by varimax, by variance explained.

    Steps go on until no noise variance moves by more than ``tolerance``, ``steps`` at the most.
    """
    matrix = nearest_positive(matrix)
    values, vectors = principal(matrix, m)
    load, noise = vectors * np.sqrt(values), np.full(len(matrix), 0.5)
    for _ in range(steps):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(noise))
        second = np.eye(m) - beta @ load + beta @ matrix @ beta.T
        load = matrix @ beta.T @ np.linalg.inv(second)
        before, noise = noise, np.maximum(np.diag(matrix - load @ beta @ matrix), 0.005)
        if np.abs(noise - before).max() <= tolerance:
            break
    load = signed(varimax(load)) if m > 1 else signed(load)
    return load[:, np.argsort(-(load**2).sum(0), kind="stable")]


def score_weights(matrix: np.ndarray, loadings: np.ndarray) -> np.ndarray:
    return np.linalg.solve(nearest_positive(matrix), loadings)


def scores(z: list[Column], weights: np.ndarray) -> Column:
    """Each row's factor scores as an array, from columns of z-scores."""
    return F.array(*[sum((z[i] * F.lit(float(w)) for i, w in enumerate(column)), F.lit(0.0)) for column in weights.T])


def block_size(d: int, most: int = 10) -> int:
    return min(most, max(1, d - 1))


def use_components(d: int, m: int) -> bool:
    """Whether a block of d variables is reduced by components rather than factors."""
    return d < 3 or m > most_factors(d) or d > 120


def block_rule(d: Column, most: int = 10) -> Column:
    """For blocks of d variables, a struct of the most factors there can be (``most_factors``, whose inequality is a square in m), of how many a block is reduced to, and of whether by components."""
    factors_at_most = F.floor((2 * d + 1 - F.sqrt(8 * d + 1)) / 2).cast("int")
    m = F.least(F.lit(most), F.greatest(F.lit(1), d - 1)).cast("int")
    return F.struct(factors_at_most.alias("most_factors"), m.alias("m"), ((d < 3) | (m > factors_at_most) | (d > 120)).alias("components"))


def average_linkage(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of variables by 1 - |r|, clusters at the mean distance of their members; a new cluster is numbered after all before."""
    d = 1 - np.abs(matrix).astype(float)
    clusters = {i: [i] for i in range(len(d))}
    merges = []
    while len(clusters) > 1:
        ids = sorted(clusters)
        pairs = [(float(d[np.ix_(clusters[a], clusters[b])].mean()), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
        best, a, b = min(pairs)
        clusters[len(d) + len(merges)] = clusters.pop(a) + clusters.pop(b)
        merges.append((a, b, best))
    return merges


def leaf_order(merges: list[tuple[int, int, float]], matrix: np.ndarray) -> list[int]:
    """Variables in the order, of all in which merged clusters stand together, that is shortest from neighbour to neighbour by 1 - |r|.

    For each cluster, the shortest order of it between any two of its ends that lie on different sides of its merge, from
    those of its two sides; the variables at the seam are kept, and the order is read off backward.
    """
    d, n = 1 - np.abs(matrix).astype(float), len(matrix)
    if not merges:
        return list(range(n))
    sides: dict[int, tuple[int, int]] = {n + k: (a, b) for k, (a, b, _) in enumerate(merges)}
    members: dict[int, np.ndarray] = {i: np.array([i]) for i in range(n)}
    cost = {i: np.zeros((1, 1)) for i in range(n)}
    for node, (a, b) in sides.items():
        left, right = members[a], members[b]
        between = d[np.ix_(left, right)]
        ends = np.stack([(row[:, None] + between).min(0) for row in cost[a]])  # from a left end to the first on the right
        across = np.stack([(row[:, None] + cost[b]).min(0) for row in ends])
        members[node] = np.concatenate([left, right])
        whole = np.full((len(members[node]),) * 2, np.inf)
        whole[: len(left), len(left) :] = across
        whole[len(left) :, : len(left)] = across.T
        cost[node] = whole

    def path(node: int, first: int, last: int) -> list[int]:
        """The order of a cluster between two ends, by their places among its members."""
        if node < n:
            return [node]
        a, b = sides[node]
        size = len(members[a])
        if first >= size:
            return path(node, last, first)[::-1]
        seam = cost[a][first][:, None] + d[np.ix_(members[a], members[b])] + cost[b][:, last - size][None]
        m, k = np.unravel_index(int(seam.argmin()), seam.shape)
        return path(a, first, int(m)) + path(b, int(k), last - size)

    top = max(sides)
    first, last = np.unravel_index(int(cost[top].argmin()), cost[top].shape)
    return path(top, int(first), int(last))


def reduce_block(matrix: np.ndarray) -> tuple[str, int, float, np.ndarray]:
    """A block of variables reduced to a few: the method, how many, the percent of variance they explain, and the weights of their scores."""
    d = len(matrix)
    m = block_size(d)
    if use_components(d, m):
        values, vectors = principal(matrix, m)
        return "components", m, 100 * float(values.sum() / np.trace(matrix)), vectors / np.sqrt(np.maximum(values, 1e-12))
    loadings = factor_analysis(matrix, m)
    return "factors", m, 100 * float((loadings**2).sum() / d), score_weights(matrix, loadings)
