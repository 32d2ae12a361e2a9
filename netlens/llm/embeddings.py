"""Embedding near-duplicates: product quantisation over coarse inverted lists, exact cosine behind it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import components, materialise

THRESHOLD = 0.93
#: Vectors of a length that its quantiser is fitted on, chosen by a hash, and their components: a bound of the sample.
TRAIN_ROWS, TRAIN_CELLS = 20_000, 1 << 23
#: Vectors in an inverted list on average, lists of a length at most, and components of all lists' centres (a bound of what is broadcast).
LIST_ROWS, MOST_LISTS, MOST_CENTRES = 400, 8192, 1 << 22
PROBES = 12
SUBSPACES, CODES = 8, 64
#: Members and queries that one cell compares at most, about: (list, member block, query block). Of vectors longer than WIDE fewer.
CELL_MEMBERS, CELL_QUERIES, WIDE = 2048, 4096, 256
#: Queries that are compared at once, and vectors that are indexed at once, of WIDE components or less.
BLOCK, INDEXED = 512, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means of a bounded sample, started from k of its rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for k in range(0, len(x), 4096):
        out[k:k + 4096] = (half - x[k:k + 4096] @ centres.T).argmin(axis=1)
    return out


@dataclass
class Quantiser:
    """Coarse centres [lists, dim] and codebooks [subspace, code, dim / subspaces] of the residuals; dim is padded to fit."""

    coarse: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantiser:
        coarse = kmeans(x, lists)
        residual = x - coarse[_nearest(x, coarse)]
        width = x.shape[1] // SUBSPACES
        books = [kmeans(residual[:, s * width:(s + 1) * width], CODES) for s in range(SUBSPACES)]
        most = max(map(len, books))
        return cls(coarse, np.stack([np.concatenate([b, np.full((most - len(b), width), 1e3)]) for b in books]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector: its list, its codes, and its exact distance to what they stand for."""
        lists = _nearest(x, self.coarse)
        residual, width = x - self.coarse[lists], x.shape[1] // SUBSPACES
        codes = np.stack([_nearest(residual[:, s * width:(s + 1) * width], self.books[s]) for s in range(SUBSPACES)], axis=1).astype(np.uint8)
        return lists, codes, np.linalg.norm(residual - self.decoded(codes), axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, its own first."""
        n = min(n, len(self.coarse))
        far = (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T
        some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(n), (len(x), 1))
        order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, order, 1).astype(np.int32)

    def estimates(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances [queries, members]: one table of query-to-code distances for each subspace, then lookups."""
        residual, width = queries - self.coarse[which], queries.shape[1] // SUBSPACES
        out = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for s in range(SUBSPACES):
            part, book = residual[:, s * width:(s + 1) * width], self.books[s]
            tables = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            out += tables.astype(np.float32)[:, codes[:, s]]
        return out


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to `dim` and on to a multiple of the subspaces (cosines stay the same)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dim + -dim % SUBSPACES))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _narrowed(rows: int, dim: int) -> int:
    """So many rows, or fewer of long vectors: as many components as of WIDE ones."""
    return max(1, rows * WIDE // max(dim, WIDE))


def _indexed(shared, probes: int):
    """Adds to each vector its list, codes, distance to what the codes stand for, and the lists it asks, its own first. Vectors of a length
    without a quantiser have one list and no codes."""

    def run(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("vec")).to_numpy()
            for dim in np.unique(sizes).tolist():
                same, step = b.take(pa.array(np.flatnonzero(sizes == dim))), _narrowed(INDEXED, dim)
                for k in range(0, same.num_rows, step):
                    part, q = same.slice(k, step), shared.value.get(dim)
                    if q is None:
                        n = part.num_rows
                        lists, codes, off, asked = np.zeros(n, dtype=np.int64), np.zeros((n, SUBSPACES), dtype=np.uint8), np.zeros(n), np.zeros((n, 1), dtype=np.int32)
                    else:
                        x = _unit(part.column("vec"), dim)
                        lists, codes, off = q.encode(x)
                        asked = q.probes(x, probes)
                    new = {"list": pa.array(lists.astype(np.int32)), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "off": pa.array(off), "asked": pa.array(list(asked), pa.list_(pa.int32()))}
                    yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], [*part.schema.names, *new])

    return run


def _spread(link: np.ndarray, q_label: np.ndarray, m_label: np.ndarray) -> None:
    """The smallest label of each connected part of a bipartite link matrix, in place."""
    big = np.iinfo(np.int64).max
    while True:
        q_new = np.minimum(q_label, np.where(link, m_label[None, :], big).min(axis=1))
        m_new = np.minimum(m_label, np.where(link, q_new[:, None], big).min(axis=0))
        if (q_new == q_label).all() and (m_new == m_label).all():
            return
        q_label[:], m_label[:] = q_new, m_new


def _compared(shared, threshold: float):
    """Rows (uid, links, root) from cells that come one after the other, members before queries: what a cell's pairs add to a
    vector's links, and an edge to the smallest vector that it reaches in one block of the cell. No pair leaves the task."""
    reach = np.sqrt(2 - 2 * threshold) + 1e-6

    def columns(b, at, end):
        s = b.slice(at, end - at)
        dim = len(s.column("vec")[0])  # a cell's vectors have one length
        return {"uid": s.column("uid").to_numpy(), "n": s.column("n").to_numpy(), "x": _unit(s.column("vec"), dim), "home": s.column("home").to_numpy(), "dim": dim, "raw": s}

    def members_of(parts):
        m = {c: np.concatenate([p[c] for p in parts]) for c in ("uid", "n", "x")}
        m["codes"] = np.concatenate([np.frombuffer(b"".join(p["raw"].column("codes").to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES) for p in parts])
        m["off"] = np.concatenate([p["raw"].column("off").to_numpy() for p in parts]).astype(np.float32)
        m["asked"] = np.concatenate([p["raw"].column("asked").flatten().to_numpy().reshape(len(p["uid"]), -1) for p in parts])
        m["dim"] = parts[0]["dim"]
        return m

    def block(m, q, which):
        """One block of queries against the members of a cell."""
        # what the codes stand for lies `off` from the vector, so no pair within reach has an estimate beyond reach + off
        quantiser = shared.value.get(m["dim"])
        near = np.ones((len(q["uid"]), len(m["uid"])), dtype=bool)
        if quantiser is not None:
            near = np.sqrt(np.maximum(quantiser.estimates(q["x"], which, m["codes"]), 0)) <= np.float32(reach + 1e-3) + m["off"][None, :]
        near &= q["uid"][:, None] != m["uid"][None, :]
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return None
        link = near[np.ix_(rows, cols)] & (q["x"][rows] @ m["x"][cols].T >= threshold)
        on_r, on_c = link.any(axis=1), link.any(axis=0)
        if not on_r.any():
            return None
        rows, cols, link = rows[on_r], cols[on_c], link[np.ix_(on_r, on_c)]
        # a member that asks for the query's list counts this link there; else it is counted here
        unasked = ~(m["asked"][cols][None, :, :] == q["home"][rows][:, None, None]).any(axis=2)
        q_label, m_label = q["uid"][rows].copy(), m["uid"][cols].copy()
        _spread(link, q_label, m_label)
        return (np.concatenate([q["uid"][rows], m["uid"][cols]]),
                np.concatenate([(link * m["n"][cols][None, :]).sum(axis=1), (link & unasked).T @ q["n"][rows]]),
                np.concatenate([q_label, m_label]))

    def run(batches):
        now, parts, members = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*[b.column(c).to_pylist() for c in ("label", "list", "mb", "qb", "query")], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                *cell, query = keys[at]
                if cell != now:
                    now, parts, members = cell, [], None
                if not query:
                    parts.append(columns(b, at, end))
                    continue
                if not parts:
                    continue
                if members is None:
                    members = members_of(parts)
                step = _narrowed(BLOCK, members["dim"])
                for k in range(at, end, step):
                    out = block(members, columns(b, k, min(end, k + step)), cell[1])
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], ["uid", "links", "root"])

    return run


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, uid): uid is a hash of label and vector, null where a vector cannot link."""
    v = F.col("vec")
    sound = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    return rows.withColumn("uid", F.when(sound, F.xxhash64("label", "vec")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors link at cosine >= threshold if their labels are equal and not null; a null or zero vector, or one with a null or
    non-finite component, links with nothing: n_links 0, component_id vec_id. Vectors are compared among their own length
    only, of however many lengths; each length with many vectors has a quantiser of its own, the others are compared exactly,
    and long vectors go in smaller blocks, so memory does not follow the longest. Equal vectors of a label are one class that is compared once and
    counts as often as it occurs; each copy links with all others. Quantisers are fitted on a bounded sample, every row is
    indexed, and a pair is found if either vector asks for the other's list: recall is measured in tests. Pruning by code
    distances loses nothing, as each code's exact error is kept. Crowded lists are cut into blocks of members and
    of queries. An empty table gives no rows; other columns are not read.
    """
    rows = _classes(vectors, id_col, vec_col, label_col)
    keyed = materialise(rows.select("vec_id", "uid", F.when(F.col("uid").isNotNull(), F.size("vec")).alias("dim")), "vectors")
    classes = materialise(rows.where("uid is not null").groupBy("uid", "label", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    lengths = {r.dim: r["count"] for r in classes.groupBy(F.size("vec").alias("dim")).count().collect()}  # a number for each length
    if not lengths:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = _pairs(classes.withColumn("label", F.concat_ws(":", F.size("vec").cast("string"), "label")), lengths, threshold, probes)
    found = materialise(found, "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    named = (classes.select("uid", "first", "n").join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
             .select("uid", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("uid", "n_links", "component_id")
    out = keyed.select("vec_id", "uid").join(named, "uid", "left")
    component = F.when(F.col("uid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _quantisers(classes: DataFrame, lengths: dict[int, int]) -> dict[int, Quantiser]:
    """One for each length with vectors for two lists or more, fitted one after the other on a sample of that length. The lists of all
    lengths together have MOST_CENTRES components at most, so what is broadcast is bounded; so is each sample."""
    many = {dim: n for dim, n in lengths.items() if n >= 2 * LIST_ROWS}
    share = MOST_CENTRES / max(1, sum(n // LIST_ROWS * dim for dim, n in many.items()))
    out = {}
    for dim, n in sorted(many.items()):
        rows = max(2, min(TRAIN_ROWS, TRAIN_CELLS // dim))
        lists = int(min(MOST_LISTS, n // LIST_ROWS, n // LIST_ROWS * share))
        if lists > 1:
            sample = classes.where(F.size("vec") == dim).orderBy(F.xxhash64("uid")).limit(max(rows, 4 * lists)).select("vec").toArrow()
            out[dim] = Quantiser.fit(_unit(sample.column("vec").combine_chunks(), dim), lists)
    return out


def _pairs(classes: DataFrame, lengths: dict[int, int], threshold: float, probes: int) -> DataFrame:
    """(uid, links, root) of the classes; labels tell lengths apart."""
    shared = classes.sparkSession.sparkContext.broadcast(_quantisers(classes, lengths))
    kinds = "uid long, label string, n long, vec array<double>, list int, codes binary, off double, asked array<int>"
    index = materialise(classes.select("uid", "label", "n", "vec").mapInArrow(_indexed(shared, probes), kinds), "index")
    cell = ["label", "list"]
    asks = index.select("uid", "label", "n", "vec", F.col("list").alias("home"), F.explode("asked").alias("list"))
    members = index.groupBy(*cell).agg(F.count(F.lit(1)).alias("members"), F.max(F.size("vec")).alias("dim"))
    queries = asks.groupBy(*cell).count().withColumnRenamed("count", "queries")
    wide = F.greatest(F.col("dim") / WIDE, F.lit(1.0))
    sizes = members.join(queries, cell).select(*cell, F.ceil(F.col("members") * wide / CELL_MEMBERS).cast("int").alias("mbs"), F.ceil(F.col("queries") * wide / CELL_QUERIES).cast("int").alias("qbs"))
    spread = lambda of, k: F.pmod(F.xxhash64("uid", F.lit(k)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = (index.join(sizes, cell).withColumns({"query": F.lit(False), "home": F.col("list"), "mb": spread("mbs", 1)}).withColumn("qb", every("qbs")))
    asked = (asks.join(sizes, cell).withColumns({"query": F.lit(True), "codes": F.lit(None).cast("binary"), "off": F.lit(None).cast("double"), "asked": F.lit(None).cast("array<int>"), "qb": spread("qbs", 2)}).withColumn("mb", every("mbs")))
    order = ["label", "list", "mb", "qb"]
    names = [*order, "query", "uid", "n", "vec", "home", "codes", "off", "asked"]
    both = held.select(*names).unionByName(asked.select(*names))
    return both.repartition(*order).sortWithinPartitions(*order, "query").mapInArrow(_compared(shared, threshold), "uid long, links long, root long")
