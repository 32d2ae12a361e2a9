"""SimHash near-duplicates: 64-bit fingerprints of whole texts, BK-trees over shards of the distinct fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import components, find, materialise

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a shard before its key is refined by further blocks of bits.
SHARD_ROWS = 4096
MASK = (1 << 64) - 1


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text: a bit is set if more than half of the word shingles' XXH64 values set it; no word: 0."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII white space splits
    n = len(words)
    if not n:
        return 0
    if n <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    starts = np.zeros(n, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words[:-1]), dtype=np.int64, count=n - 1) + 1, out=starts[1:])
    ends = starts[size - 1:] + np.fromiter(map(len, words[size - 1:]), dtype=np.int64, count=n - size + 1)
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    starts, ends = starts[: n - size + 1].tolist(), ends.tolist()
    for k in range(0, len(ends), 16384):
        h = np.array([digest(flat[s:e], SEED) for s, e in zip(starts[k:k + 16384], ends[k:k + 16384], strict=True)], dtype=np.uint64)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(ends), bitorder="little").view(np.uint64)[0])


def _hashed(batches):
    for b in batches:
        fp = np.fromiter(map(fingerprint, b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long. A null text has no words: 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_hashed, "doc_id long, fp long")


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it.

    Each node also knows whether its whole subtree belongs to one class (`one`: any of its members, or -1), so that a
    query that is already of this class skips it: a crowd of near copies costs one hit each, not one for each pair.
    """

    def __init__(self, radius: int):
        self.radius, self.value, self.children, self.one, self.parent = radius, [], [], [], []

    def add(self, q: int) -> None:
        """Insert q and join its class with that of every value within the radius, reached by edges d - radius .. d + radius."""
        value, children, one, parent, r = self.value, self.children, self.one, self.parent, self.radius
        i = len(value)
        value.append(q)
        children.append({})
        one.append(i)
        parent.append(i)
        if not i:
            return
        stack = [0]
        while stack:
            n = stack.pop()
            if one[n] >= 0 and find(parent, one[n]) == find(parent, i):
                continue
            d = (q ^ value[n]).bit_count()
            if d <= r:
                a, b = find(parent, n), find(parent, i)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            for e, child in children[n].items():
                if d - r <= e <= d + r:
                    stack.append(child)
        mine, n = find(parent, i), 0
        while True:
            if one[n] >= 0 and find(parent, one[n]) != mine:
                one[n] = -1
            d = (q ^ value[n]).bit_count()
            if d not in children[n]:
                children[n][d] = i
                return
            n = children[n][d]

    def links(self) -> list[tuple[int, int]]:
        """Each value with the first one of its class, enough to connect the class."""
        return [(self.value[i], self.value[r]) for i in range(len(self.value)) if (r := find(self.parent, i)) != i]


def _bands(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """Values within the radius differ in at most `radius` of the blocks, so they agree on one of these choices of the others."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [[(cuts[k], cuts[k + 1] - cuts[k]) for k in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def _bits(column, low: int, width: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))


def _shards(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(shard, band, fp): one row for each band; the shard is the hash of the band's bits."""
    keys = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), *[_bits(F.col("fp"), *b) for b in band]).alias("shard")) for i, band in enumerate(_bands(blocks, radius))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.shard", "k.band", "fp")


def _refined(rows: DataFrame, blocks: int, radius: int, parts: int = 4) -> DataFrame:
    """Crowded shards: what is left of the bits differs in at most `radius` places too, so the same cut holds once more."""
    out = None
    for i, band in enumerate(_bands(blocks, radius)):
        fixed = {b for low, width in band for b in range(low, low + width)}
        free = [b for b in range(64) if b not in fixed]
        cuts = [len(free) * k // parts for k in range(parts + 1)]
        keys = [F.xxhash64("shard", F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in free[cuts[j]:cuts[j + 1]]))))) for j in range(parts)]
        these = rows.where(F.col("band") == i).select(F.explode(F.array(*keys)).alias("shard"), "fp")
        out = these if out is None else out.unionByName(these)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(radius: int):
    def run(batches):
        now, tree, rows = None, None, []

        def flushed(rows):
            pairs = np.array(rows, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        for b in batches:
            for shard, fp in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
                if shard != now:
                    if tree is not None and len(tree.value) > 1:
                        rows += tree.links()
                    now, tree = shard, BKTree(radius)
                tree.add(fp)
            if len(rows) >= 4096:
                yield flushed(rows)
                rows = []
        if tree is not None:
            rows += tree.links()
        yield flushed(rows)

    return run


def _trees(rows: DataFrame, radius: int) -> DataFrame:
    """Each shard's fingerprints meet in one task, in order of the shard; its tree lives there until the next shard begins."""
    return rows.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_linked(radius), "u long, v long")


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints(fp long) at `radius` differing bits or fewer, through BK-trees of shards.

    A fingerprint goes to the shards of its bands (pigeonhole: every pair within the radius meets in one), so a tree
    holds what can match; the number of blocks follows the number of fingerprints, and crowded shards are cut once more.
    """
    n, blocks = fps.count(), radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 256 and blocks < 12:
        blocks += 1
    rows = _shards(fps, blocks, radius)
    sizes = rows.groupBy("shard").count()
    rows = rows.join(sizes.where("count > 1"), "shard")
    calm, crowded = rows.where(F.col("count") <= SHARD_ROWS), rows.where(F.col("count") > SHARD_ROWS)
    rows = calm.select("shard", "fp")
    if sizes.where(F.col("count") > SHARD_ROWS).limit(1).count():
        rows = rows.unionByName(_refined(crowded, blocks, radius))
    return _trees(rows, radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and wordless texts share fingerprint zero and link like any other; repeated rows each get a row; a null doc_id
    is kept, never chosen as component_id if another id is there. Other input columns are not read. Equal fingerprints
    collapse before the search, so a group of copies counts once there.
    """
    hashed = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    return grouped(hashed, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hashed(doc_id, fp, ...) with component_id and n_rows (rows of the component); hashed should be a written table."""
    fps = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = components(near_links(fps.select("fp"), radius))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("n_rows"))
    named = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id", "n_rows")
    return hashed.join(named, "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays (of rows that share it, the one with
    the smallest hash of all columns; fully equal rows once). Columns are those of docs."""
    names = docs.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    tagged = docs.select(F.col(id_col).cast("long").alias("_id"), row.alias("_row"), F.col(text_col).cast("string").alias("_text"))
    hashed = materialise(tagged.mapInArrow(_tagged, "doc_id long, fp long, tag long"), "fingerprints")
    groups = grouped(hashed, radius)
    chosen = (groups.where("n_rows > 1").select("component_id", "doc_id", "tag", "fp")
              .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "tag", "fp")).alias("k")).select("k.doc_id", "k.tag"))
    lone = groups.where("n_rows = 1").select("doc_id", "tag")
    keep = lone.withColumn("once", F.lit(False)).unionByName(chosen.withColumn("once", F.lit(True)))
    keyed = docs.withColumns({"_netlens_id": F.col(id_col).cast("long"), "_netlens_tag": row})
    keep = keep.select(F.col("doc_id").alias("_netlens_k"), F.col("tag").alias("_netlens_t"), F.col("once").alias("_netlens_once"))
    kept = keyed.join(keep, (F.col("_netlens_tag") == F.col("_netlens_t")) & F.col("_netlens_id").eqNullSafe(F.col("_netlens_k")))
    cols = [F.col(f"`{c}`") for c in names]
    return kept.where("not _netlens_once").select(*cols).unionByName(kept.where("_netlens_once").select(*cols).dropDuplicates())


def _tagged(batches):
    for b in batches:
        fp = np.fromiter(map(fingerprint, b.column(2).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(1)], ["doc_id", "fp", "tag"])
