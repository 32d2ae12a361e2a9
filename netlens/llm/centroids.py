"""Centroid clustering: exact integer k-means whose nearest centroids come from a progressive Walsh-Hadamard search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialise
from netlens.llm.integer_vectors import add_by, integer_vectors, matrix

DIM, CLUSTERS, ROUNDS = 64, 40, 5
#: Coefficients are compared up to these counts, one after the other.
STEPS = (4, 8, 16, 32, 64)
#: Vectors times centroids that are compared at once.
CELLS = 1 << 18


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row by the 64 x 64 matrix of +1 and -1, unscaled, coarse to fine: a coefficient's number is how often
    its row of the matrix changes sign. Squared distances of transforms are 64 times those of the rows."""
    y = x.astype(np.int64)
    n, h = y.shape[1], 1
    while h < n:
        z = y.reshape(len(y), -1, 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), n)
        h *= 2
    return y[:, _ORDER] if n == DIM else y


def _by_sign_changes() -> np.ndarray:
    rows = walsh_hadamard(np.concatenate([np.eye(DIM, dtype=np.int64), np.zeros((1, DIM), dtype=np.int64)]))[:DIM].T
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


_ORDER = np.arange(DIM)
_ORDER = _by_sign_changes()


class Search:
    """Nearest centroids. Sums of squared coefficient differences only grow, so a centroid whose sum passes the whole one of the
    centroid that leads after the first step is strictly worse and goes; equal sums stay, and the smallest number wins."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.coefficients = centroids, walsh_hadamard(centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of x."""
        step = max(1, CELLS // len(self.centroids))
        parts = [self._nearest(walsh_hadamard(x[k:k + step])) for k in range(0, len(x), step)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, dtype=np.int64),) * 2

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, at = self.coefficients, STEPS[0]
        first = ((x[:, None, :at] - c[None, :, :at]) ** 2).sum(axis=2)
        bound = ((x - c[first.argmin(axis=1)]) ** 2).sum(axis=1)
        rows, cols = np.nonzero(first <= bound[:, None])
        sums = first[rows, cols]
        for end in STEPS[1:]:
            sums = sums + ((x[rows, at:end] - c[cols, at:end]) ** 2).sum(axis=1)
            stays = sums <= bound[rows]
            rows, cols, sums, at = rows[stays], cols[stays], sums[stays], end
        # rows are in order, and so are the centroids of each; every row has kept the one that led
        begin = np.searchsorted(rows, np.arange(len(x)))
        least = np.minimum.reduceat(sums, begin)
        best = np.flatnonzero(sums == least[rows])
        return cols[best[np.searchsorted(rows[best], np.arange(len(x)))]], least // DIM


def _summed(shared):
    """Sums and counts by centroid of a whole task: rows (cluster, at, total), with the count at -1."""

    def run(batches):
        search: Search = shared.value
        k = len(search.centroids)
        sums, counts = np.zeros((k, DIM), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = matrix(b.column("v"), DIM)
            add_by(search.nearest(x)[0], x, sums, counts)
        met = np.flatnonzero(counts)
        values = np.concatenate([counts[met, None], sums[met]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, DIM + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, DIM, dtype=np.int32), len(met))), pa.array(values.ravel())], ["cluster", "at", "total"])

    return run


def _assigned(shared):
    def run(batches):
        for b in batches:
            cluster, distance = shared.value.nearest(matrix(b.column("v"), DIM))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def fit(kept: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after `rounds` of Lloyd's rule with floored means. Each task sends one sum for each centroid and component."""
    spark = kept.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Search(centroids))
        totals = kept.select("v").mapInArrow(_summed(shared), "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).toArrow()
        sums = np.zeros((len(centroids), DIM + 1), dtype=np.int64)
        sums[totals.column("cluster").to_numpy(), totals.column("at").to_numpy() + 1] = totals.column("total").to_numpy()
        met = sums[:, 0] > 0
        centroids = centroids.copy()
        centroids[met] = sums[met, 1:] // sums[met, :1]
        shared.unpersist()
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each vector of exactly 64 components, none null or non-finite: vec_id, cluster, distance (squared, of integers
    floor(256 x)), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the vectors with the smallest sha256 of "2:<vec_id>"; of equal ids the smaller vector is first, null ids come
    last, and with fewer vectors there are as many centroids. Ties go to the smaller number, an empty centroid stays. Other rows
    have no row here; repeated rows have one each; an empty table gives none; other columns are not read. The driver and each
    task hold the centroids (their number is the parameter) and no vectors: a round is one pass that shuffles sums.
    """
    kept = materialise(integer_vectors(vectors.where(F.size(vec_col) == DIM), id_col, vec_col), "integers")
    start = kept.orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).select("v").toArrow()
    if not start.num_rows:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    final = fit(kept, matrix(start.column("v").combine_chunks(), DIM), rounds)
    shared = kept.sparkSession.sparkContext.broadcast(Search(final))
    out = materialise(kept.mapInArrow(_assigned(shared), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each centroid
    each = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    return out.select("vec_id", "cluster", "distance", each([sums.get(k, 0) for k in range(len(final))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), each(hashes, "string").alias("centroid_sha256"))


#: The same rows as SQL, with production parameters.
SQL = """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
flat AS MATERIALIZED (SELECT rid, unnest(range(64)) AS pos, CAST(unnest(v) AS BIGINT) AS x FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)),
""" + "".join(f"""a{r} AS MATERIALIZED (SELECT rid, min(d * 64 + cluster) AS best FROM (SELECT rid, cluster, CAST(list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d
 FROM kept k, c{r} c) GROUP BY rid),
""" + (f"""m{r} AS (SELECT best % 64 AS cluster, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN flat USING (rid) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS v FROM m{r} GROUP BY cluster) m USING (cluster)),
""" if r < ROUNDS else "") for r in range(ROUNDS + 1)) + f"""got AS (SELECT vec_id, best % 64 AS cluster, best // 64 AS distance FROM a{ROUNDS} JOIN kept USING (rid))
SELECT vec_id, CAST(got.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY got.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM got JOIN c{ROUNDS} c ON c.cluster = got.cluster"""
