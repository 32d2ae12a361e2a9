"""Vector code compression: integer product codebooks whose nearest entries come from a GNAT over the entries."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialise
from netlens.llm.integer_vectors import add_by, integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Split points of a node, and entries that a leaf holds.
DEGREE, LEAF = 8, 6
#: Relative room for rounding of square roots: far above a double's, far below what matters.
_SLACK = 1e-12


@dataclass
class Gnat:
    """Geometric near-neighbour access tree of integer points. `low` and `high` [split, child] bound the distances from a split
    point to all points in a child's subtree, rounded outwards. A leaf has no children."""

    points: np.ndarray
    ids: np.ndarray
    children: list[Gnat | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray) -> Gnat:
        if len(points) <= LEAF:
            return cls(points, ids)
        splits = [0]
        far = ((points - points[0]) ** 2).sum(axis=1)
        while len(splits) < DEGREE and far.max() > 0:  # the next split point is the farthest from all before
            splits.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[splits[-1]]) ** 2).sum(axis=1))
        if len(splits) < 2:
            return cls(points, ids)  # all equal
        rest = np.setdiff1d(np.arange(len(points)), splits)
        squares = ((points[rest][:, None] - points[splits][None]) ** 2).sum(axis=2)
        home = squares.argmin(axis=1)
        low, high = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
        children: list[Gnat | None] = []
        for j in range(len(splits)):
            inside = rest[home == j]
            children.append(cls.build(points[inside], ids[inside]) if len(inside) else None)
            if len(inside):
                d = np.sqrt(squares[home == j].astype(np.float64))
                low[:, j], high[:, j] = d.min(axis=0) * (1 - _SLACK), d.max(axis=0) * (1 + _SLACK)
        return cls(points[splits], ids[splits], children, low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x; equal integer distances go to the lower entry."""
        best, entry = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        self._search(x, np.arange(len(x)), best, entry)
        return entry, best

    def _search(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        squares = ((x[rows][:, None] - self.points[None]) ** 2).sum(axis=2)
        least = squares.min(axis=1)
        first = np.where(squares == least[:, None], self.ids[None], np.iinfo(np.int64).max).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[better], first[better]
        if not self.children:
            return
        away, home = np.sqrt(squares.astype(np.float64)), squares.argmin(axis=1)
        for own in (True, False):  # the child of the nearest split point first: it brings the radius down for all others
            for j, child in enumerate(self.children):
                if child is None:
                    continue
                some = np.flatnonzero((home == j) == own)
                # strictly beyond the radius, even with everything rounded in the subtree's favour
                radius = np.sqrt(best[rows[some]].astype(np.float64))[:, None] * (1 + _SLACK)
                a = away[some]
                gone = (a * (1 - _SLACK) - self.high[:, j] > radius) | (self.low[:, j] - a * (1 + _SLACK) > radius)
                some = some[~gone.any(axis=1)]
                if len(some):
                    child._search(x, rows[some], best, entry)


@dataclass
class Codebooks:
    """Entries [part, entry, component] and a tree over each part's."""

    entries: np.ndarray

    def __post_init__(self):
        self.trees = [Gnat.build(e, np.arange(len(e))) for e in self.entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry [row, part], squared distance [row, part])."""
        width = self.entries.shape[2]
        got = [tree.nearest(x[:, p * width:(p + 1) * width]) for p, tree in enumerate(self.trees)]
        return np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


#: Vectors times components that are compared at once.
CELLS = 1 << 20


def _slices(batches, dim: int):
    step = max(1, CELLS // max(1, dim))
    for b in batches:
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def _padded(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    return np.pad(matrix(column, dim), ((0, 0), (0, -dim % parts)))


def _summed(shared, dim: int):
    """Sums and counts by part and entry of a whole task: rows (part, entry, at, total), with the count at -1."""

    def run(batches):
        books: Codebooks = shared.value
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in _slices(batches, dim):
            x = _padded(b.column("v"), dim, parts)
            which, _ = books.assign(x)
            for p in range(parts):
                add_by(which[:, p], x[:, p * width:(p + 1) * width], sums[p], counts[p])
        part, entry = np.nonzero(counts)
        values = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
        each = lambda v: pa.array(np.repeat(v, width + 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([each(part), each(entry), pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(part))), pa.array(values.ravel())], ["part", "entry", "at", "total"])

    return run


def _coded(shared, dim: int):
    def run(batches):
        books: Codebooks = shared.value
        parts = len(books.entries)
        for b in _slices(batches, dim):
            which, off = books.assign(_padded(b.column("v"), dim, parts))
            text = which.astype(np.uint8).tobytes().hex()
            codes = [text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(off.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def fit(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors of one length: first those of the smallest ids, then rounds of floored means."""
    spark = kept.sparkSession
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    x = _padded(start.column("v").combine_chunks(), dim, parts)
    books = Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        totals = kept.select("v").mapInArrow(_summed(shared, dim), "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).toArrow()
        sums = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), dtype=np.int64)
        sums[totals.column("part").to_numpy(), totals.column("entry").to_numpy(), totals.column("at").to_numpy() + 1] = totals.column("total").to_numpy()
        met, new = sums[:, :, 0] > 0, books.entries.copy()
        new[met] = sums[met][:, 1:] // sums[met][:, :1]
        books = Codebooks(new)
        shared.unpersist()
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each vector that is not null and has no null or non-finite component: vec_id, code (two hex digits for each
    part), error (squared, of integers floor(256 x)), label_error (error summed over equal labels, nulls together),
    codebooks_sha256.

    Codebooks start as the parts of the smallest vec_ids; of equal ids the smaller vector is first, null ids come last, and with
    fewer vectors there are as many entries. Ties go to the lower entry, unused entries stay. A length that the number of parts
    does not divide is filled up with zeros, which adds nothing to a distance; vectors of different lengths have codebooks of
    their own, made one length after the other. Repeated rows have a row each; an empty table gives none; other columns are
    not read. The driver and each task hold one length's codebooks and no vectors: a round is one pass that shuffles sums.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = integer_vectors(vectors.withColumn("_label", F.col(label_col)), id_col, vec_col, "_label").withColumnRenamed("_label", "label")
    kept = materialise(rows.withColumn("dim", F.size("v")), "integers")
    label = kept.schema["label"].dataType.simpleString()
    coded = []
    for (dim,) in sorted(kept.select("dim").distinct().collect()):
        same = kept.where(F.col("dim") == dim)
        books = fit(same, dim, parts, entries, rounds)
        shared = kept.sparkSession.sparkContext.broadcast(books)
        coded.append(same.select("vec_id", "label", "v").mapInArrow(_coded(shared, dim), f"vec_id long, label {label}, code string, error long").withColumn("codebooks_sha256", F.lit(books.sha256())))
    if not coded:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = materialise(reduce(DataFrame.unionAll, coded), "codes")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: The same rows as SQL, with production parameters, for vectors of one length that the parts divide.
SQL = """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, len(embedding) // 16 AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT rid, vec_id, part, v[part * w + 1:(part + 1) * w] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
flat AS MATERIALIZED (SELECT rid, part, unnest(range(len(v))) AS pos, CAST(unnest(v) AS BIGINT) AS x FROM p),
c0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
""" + "".join(f"""a{r} AS MATERIALIZED (SELECT rid, part, min(d * 64 + entry) AS best FROM (SELECT rid, p.part, entry, CAST(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d
 FROM p JOIN c{r} c USING (part)) GROUP BY rid, part),
""" + (f"""m{r} AS (SELECT part, best % 64 AS entry, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN flat USING (rid, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS v FROM m{r} GROUP BY part, entry) m USING (part, entry)),
""" if r < ROUNDS else "") for r in range(ROUNDS + 1)) + f"""got AS (SELECT rid, string_agg(lpad(format('{{:x}}', best % 64), 2, '0'), '' ORDER BY part) AS code, sum(best // 64) AS error FROM a{ROUNDS} GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM got JOIN kept USING (rid), book"""
