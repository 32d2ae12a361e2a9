"""Line dedup: an exact set-similarity join of all lines by their word sets; later matches are removed."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import components, materialise
from netlens.llm.tokens import blocks, mixed, tokens

#: Jaccard similarity of word sets from which lines match, in hundredths, so that all bounds are whole numbers.
PERCENT = 80
#: Most frequent words, ranked by their counts (a bound of the broadcast, 16 bytes each); the others count as equally rare.
RANKED = 1 << 16
#: Sets of up to this many words can only match sets of one word more or less; they are joined by subsets.
SHORT = 7
#: Words that stand in more sets than this make a crowd: where a prefix has one, a second shared word is asked for.
CROWD = 2000
#: Set keys that a task remembers, to write the words of a line that repeats within it once.
SEEN = 250_000
#: Postings of a bucket on average; a bucket with more than HOT times as many is cut into blocks, and each two of them meet in a task.
BUCKET, HOT = 200_000, 4
#: Sets of a cell, in which all are compared with all.
CELL = 512

#: Bits of a word's hash that name it. Two words of a pair of lines share them with a chance of about one in 10**12.
ID_BITS = 40
_ID = np.uint64((1 << ID_BITS) - 1)
#: Slots of the table of ranked words; of two that fall into one slot the more frequent one is ranked.
SLOTS = 1 << 21
#: Stands for a null doc_id, which is before all others.
_NULL_ID = -(1 << 63)


def least_size(n):
    """The size of the smallest set that can match one of n words."""
    return -(-n * PERCENT // 100)


class Order:
    """A total order of words: unranked ones first, by hash, then ranked ones by rising count; and which words make a crowd."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        by = np.lexsort((ids, counts))  # a slot that is written twice keeps the more frequent word
        self.ids, self.ranks = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.uint32)
        slot = ids[by] & (SLOTS - 1)
        self.ids[slot], self.ranks[slot] = ids[by], np.arange(1, len(by) + 1, dtype=np.uint32)
        self.crowd_from = int((counts <= CROWD).sum()) + 1

    def rank(self, ids: np.ndarray) -> np.ndarray:
        slot = ids & (SLOTS - 1)
        return np.where(self.ids[slot] == ids, self.ranks[slot], np.uint32(0)).astype(np.uint64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.rank(ids) << np.uint64(23) | ids.astype(np.uint64) >> np.uint64(17)


class Sets:
    """Word sets: keys, sizes, where each begins, and of all their words the ids and the set that each belongs to.

    A key is the sum of its words' mixed ids, so that the key of a subset is a difference.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.owner, self.starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes

    @cached_property
    def mixed(self) -> np.ndarray:
        return mixed(self.ids.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))

    @cached_property
    def keys(self) -> np.ndarray:
        return np.add.reduceat(self.mixed, self.starts) if len(self.sizes) else np.zeros(0, dtype=np.uint64)

    @classmethod
    def of_block(cls, block: pa.RecordBatch) -> tuple[Sets, np.ndarray, np.ndarray]:
        """The sets of a block's lines that have a word, ids sorted; row and line number of each."""
        t = tokens(block.column(1))
        new = np.ones(len(t.rows), dtype=bool)
        new[1:] = (t.rows[1:] != t.rows[:-1]) | (t.lines[1:] != t.lines[:-1])
        line = np.cumsum(new) - 1
        packed = np.sort(line.astype(np.uint64) << np.uint64(ID_BITS) | t.hashes >> np.uint64(64 - ID_BITS))
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
        sizes = np.bincount((packed >> np.uint64(ID_BITS)).astype(np.int64), minlength=int(new.sum()))
        return cls((packed & _ID).astype(np.int64), sizes), t.rows[new], t.lines[new].astype(np.int32)

    @classmethod
    def of_words(cls, words: pa.Array) -> Sets:
        """The sets of a column that packed() made."""
        edges, data = words.buffers()[1:]
        at = np.frombuffer(edges, dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, dtype=np.int64)
        raw = np.zeros((int(at[-1] - at[0]) // 5, 8), dtype=np.uint8)
        if len(raw):
            raw[:, :5] = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]].reshape(-1, 5)
        return cls(raw.view("<i8").ravel(), np.diff(at) // 5)

    def packed(self, on: np.ndarray) -> pa.Array:
        """The words of the sets that are `on`, five bytes each; null for the others."""
        raw = np.ascontiguousarray(self.ids[on[self.owner]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        ends = np.concatenate([[0], np.cumsum(np.where(on, self.sizes, 0))]) * 5
        return pa.Array.from_buffers(pa.binary(), len(on), [pa.array(on).buffers()[1], pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Seen:
    """Whether this task has had a key; forgets all when full, which only makes a set count as new once more."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, keys: list[int]) -> np.ndarray:
        if len(self.keys) > SEEN:
            self.keys.clear()
        out = np.zeros(len(keys), dtype=bool)
        for i, k in enumerate(keys):
            if k not in self.keys:
                self.keys.add(k)
                out[i] = True
        return out


_LINES = "doc_id long, line_no int, key long, size int, words binary"


def _lined(batches):
    """A row for each line with a word; its words only where the task has not had the set before. The one pass over the texts."""
    seen = _Seen()
    for b in batches:
        for block in blocks(b):
            s, rows, lines = Sets.of_block(block)
            if len(rows):
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(rows)), pa.array(lines), _long(s.keys), pa.array(s.sizes.astype(np.int32)), s.packed(seen.new(s.keys.tolist()))], [x.split()[0] for x in _LINES.split(", ")])


def _frequencies(batches):
    """(word, n) of sets, added up for some millions of words at a time."""
    held, n = [], 0

    def out():
        ids = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.int64)
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([_long(ids[cut]), pa.array(np.diff(np.append(cut, len(ids))))], ["word", "n"])

    for b in batches:
        ids = Sets.of_words(b.column("words")).ids
        held.append(ids)
        n += len(ids)
        if n > 2_000_000:
            yield out()
            held, n = [], 0
    yield out()


def _subsets(batches):
    """(key, a): of sets of 5 to SHORT + 1 words the keys of their subsets without one word."""
    for b in batches:
        s = Sets.of_words(b.column("words"))
        yield pa.RecordBatch.from_arrays([_long(s.keys[s.owner]), _long(s.keys[s.owner] - s.mixed)], ["key", "a"])


def meetings(s: Sets, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit numbers under which sets of more than SHORT words meet similar ones, the set of each, the place of the shared word).

    Similar sets share a word of their prefixes, and two words of the prefixes that are one word longer. So a set has a
    number for each word of its prefix that is not in a crowd, and one for each two words of the longer prefix that both are:
    crowds stand at the end of the order, so if sets share a crowd's word in their prefixes, any other word that they
    share and that is in no crowd stands before it, in both prefixes. A pair has place 0, which says nothing. Two meetings
    under one number by chance make a candidate more, which the filters or the verification drop.
    """
    long = s.sizes > SHORT
    on = long[s.owner]
    ids, owner = s.ids[on], s.owner[on]
    by = np.argsort(owner.astype(np.uint64) << np.uint64(ID_BITS) | order(ids), kind="stable")
    ids, sizes = ids[by], s.sizes[long]
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    reach = (s.sizes - least_size(s.sizes) + 1)[owner]
    near = place <= reach
    ids, owner, place, reach = ids[near], owner[near], place[near], reach[near]
    crowd = order.rank(ids) >= np.uint64(order.crowd_from)
    single = (place < reach) & ~crowd
    last = np.flatnonzero(crowd)
    begin = np.searchsorted(owner[last], owner[last])
    counts = np.arange(len(last)) - begin
    second = np.repeat(last, counts)
    first = last[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)]
    words = mixed(ids.astype(np.uint64))
    numbers = np.concatenate([words[single], mixed(words[first] * np.uint64(3) + words[second])])
    return (numbers >> np.uint64(32)).astype(np.uint32), np.concatenate([owner[single], owner[second]]), np.concatenate([place[single], np.zeros(len(second), dtype=np.int64)])


#: A posting. A place or size beyond 65534 is kept as 65535, which every filter lets pass.
_POSTING = np.dtype([("number", "<u4"), ("size", "<u2"), ("place", "<u2"), ("key", "<i8"), ("b1", "<u8"), ("b2", "<u8")])
_MOST = 65535


def _bucket(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (numbers >> np.uint32(31 - bits) >> np.uint32(1)).astype(np.int32)


def _counted(shared, bits: int):
    """(bucket, n) of the postings of sets."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            counts += np.bincount(_bucket(meetings(Sets.of_words(b.column("words")), shared.value)[0], bits), minlength=1 << bits)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(counts[on])], ["bucket", "n"])

    return run


def _postings(shared, bits: int, cuts: dict[int, int]):
    """Postings of sets, packed by bucket and cell: rows (bucket, cell, postings). A bucket that is not in cuts is one cell; of one
    with n blocks each two make a cell, and a posting goes to all cells of its block."""

    def run(batches):
        held, n = [], 0

        def out():
            x = np.concatenate(held)
            bucket = _bucket(x["number"], bits)
            by = np.argsort(bucket, kind="stable")
            x, bucket = x[by], bucket[by]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows, plain = [], []
            for k, (s, e) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True)):
                parts = cuts.get(int(bucket[s]), 1)
                if parts == 1:
                    plain.append(k)
                    continue
                mine = x[s:e]
                block = (mixed(mine["key"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for i in range(parts):
                    for j in range(i, parts):
                        some = mine[(block == i) | (block == j)]
                        if len(some):
                            rows.append((int(bucket[s]), i * parts + j, some.tobytes()))
            if len(plain) < len(at):
                rows += [(int(bucket[at[k]]), 0, x[at[k]:(at[k + 1] if k + 1 < len(at) else len(x))].tobytes()) for k in plain]
                cols = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["bucket", "cell", "postings"])
            ends = np.append(at, len(x)) * _POSTING.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.zeros(len(at), dtype=np.int32)), packed], ["bucket", "cell", "postings"])

        for b in batches:
            s = Sets.of_words(b.column("words"))
            numbers, owner, place = meetings(s, shared.value)
            if not len(numbers):
                continue
            bit, high = np.uint64(1) << (s.mixed & np.uint64(63)), (s.mixed >> np.uint64(6)) & np.uint64(1) == 1
            x = np.empty(len(numbers), dtype=_POSTING)
            x["number"], x["size"], x["place"], x["key"] = numbers, np.minimum(s.sizes, _MOST)[owner], np.minimum(place, _MOST), s.keys.view(np.int64)[owner]
            for c, half in (("b1", high), ("b2", ~high)):
                x[c] = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), s.starts)[owner]
            held.append(x)
            n += len(x)
            if n > 400_000:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def united(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest members of classes, after u and v are joined pair by pair; parent holds them before."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)


#: Pairs of postings that are held against each other at once.
PAIRS = 1 << 19


def _solved_bucket(raw: bytes) -> pa.RecordBatch:
    """Edges (u, v) that connect the sets of a cell as candidates do: stars, one row for each set at most.

    Postings of a number stand in order of size, and each is held against those before it that are not too small (the length
    filter). A word shared at two places leaves so many words before and behind it to share (the positional filter), and each
    word that only one set has turns one of 128 parities, so that many may differ at most. Sets that are connected already
    need no further test.
    """
    x = np.frombuffer(raw, dtype=_POSTING)
    by = np.argsort(x["number"].astype(np.uint64) << np.uint64(16) | x["size"].astype(np.uint64), kind="stable")
    number = x["number"][by]
    same = number[1:] == number[:-1]
    by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    x = x[by]
    number, size, place = x["number"].astype(np.int64), x["size"].astype(np.int64), x["place"].astype(np.int64)
    keys, at = np.unique(x["key"], return_inverse=True)
    b1, b2 = np.ascontiguousarray(x["b1"]), np.ascontiguousarray(x["b2"])
    parent = np.arange(len(keys))
    low = np.searchsorted(number << 16 | size, number << 16 | least_size(size))
    width = np.arange(len(x)) - low
    total = np.cumsum(width)
    begin = 0
    while begin < len(x):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        # one posting with more partners than PAIRS is a chunk of its own
        w = width[begin:end]
        i = np.repeat(np.arange(begin, end), w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[begin:end], w)
        apart = parent[at[i]] != parent[at[j]]
        i, j = i[apart], j[apart]
        a, b, p, q = size[i], size[j], place[i], place[j]
        need, every = -(-PERCENT * (a + b) // (100 + PERCENT)), a == _MOST
        ok = (np.minimum(a - p, b - q) + np.minimum(p, q) >= need) | every
        i, j, most, every = i[ok], j[ok], (a + b - 2 * need)[ok], every[ok]
        odd = np.bitwise_count(b1[i] ^ b1[j]).astype(np.int64) + np.bitwise_count(b2[i] ^ b2[j])
        ok = (odd <= most) | every
        if ok.any():
            parent = united(parent, at[i[ok]], at[j[ok]])
        begin = end
    on = np.flatnonzero(parent != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(keys[parent[on]])], ["u", "v"])


def _met(batches):
    now, parts = None, []
    for b in batches:
        for bucket, cell, raw in zip(b.column("bucket").to_pylist(), b.column("cell").to_pylist(), b.column("postings"), strict=True):
            if (bucket, cell) != now:
                if parts:
                    yield _solved_bucket(b"".join(parts))
                now, parts = (bucket, cell), []
            parts.append(raw.as_py())
    if parts:
        yield _solved_bucket(b"".join(parts))


def _candidates(sets: DataFrame, order) -> DataFrame:
    """(node, root): the sets that have a candidate, and the smallest key of those that candidates connect them with."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.col("size") / 5 + 1), F.lit(0.0))).first()[0]
    bits = min(22, max(0, int(total / BUCKET).bit_length()))
    # a sixteenth of the sets tells which buckets are hot; this decides how they are cut, not what is compared
    some = sets.where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0)
    counts = some.mapInArrow(_counted(order, bits), "bucket int, n long").groupBy("bucket").agg((16 * F.sum("n")).alias("n"))
    hot = counts.where(F.col("n") > HOT * BUCKET).toArrow()  # of 2**bits buckets at most
    cuts = {b: -(-n // BUCKET) for b, n in zip(hot.column("bucket").to_pylist(), hot.column("n").to_pylist(), strict=True)}
    rows = sets.mapInArrow(_postings(order, bits, cuts), "bucket int, cell int, postings binary")
    edges = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_met, "u long, v long")
    roots = components(edges)
    return materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "candidates")


_FOUND = "key long, links long, doc_id long, line_no int, to long"


def _solved_cell(left: pa.Table, right: pa.Table | None) -> pa.RecordBatch | None:
    """Verified links of the sets of a cell, among the left ones or between the two sides: of each linked set how many lines it links with,
    the first place of them, and the smallest set that links lead to."""
    both = left if right is None else pa.concat_tables([left, right])
    s = Sets.of_words(pa.concat_arrays(both.column("words").chunks))
    n, m = left.num_rows, both.num_rows
    cols = (0, n) if right is None else (n, m)
    _, word, times = np.unique(s.ids, return_inverse=True, return_counts=True)
    shared = times[word] > 1
    word, owner = np.unique(word[shared], return_inverse=True)[1], s.owner[shared]
    by = np.argsort(word, kind="stable")
    word, owner = word[by], owner[by]
    common = np.zeros((n, cols[1] - cols[0]), dtype=np.float32)
    for lo in range(0, int(word[-1]) + 1 if len(word) else 0, 2048):
        a, b = np.searchsorted(word, (lo, lo + 2048))
        x = np.zeros((m, min(2048, int(word[-1]) + 1 - lo)), dtype=np.float32)
        x[owner[a:b], word[a:b] - lo] = 1
        common += x[:n] @ x[cols[0]:cols[1]].T
    sizes = s.sizes.astype(np.float64)
    link = common.astype(np.float64) * (100 + PERCENT) >= PERCENT * (sizes[:n, None] + sizes[None, cols[0]:cols[1]])
    if right is None:
        np.fill_diagonal(link, False)
    i, j = np.nonzero(link)
    if not len(i):
        return None
    j = j + cols[0]
    if right is not None:
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
    key, times = both.column("key").to_numpy(), both.column("n").to_numpy()
    doc, line = both.column("doc_id").to_numpy(), both.column("line_no").to_numpy()
    return _rows(both, i, j)


def _rows(both, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """_FOUND from links (i, j) of the rows of a table, each in both directions."""
    key, times, doc, line = (both.column(c).to_numpy() for c in ("key", "n", "doc_id", "line_no"))
    m = len(key)
    links, rank = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    np.add.at(links, i, times[j])
    place = np.lexsort((line, doc))
    rank[place] = np.arange(m)
    earliest = np.full(m, m)
    np.minimum.at(earliest, i, rank[j])
    root = united(np.arange(m), i, j)
    on = np.flatnonzero(links)
    to = place[earliest[on]]
    return pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(links[on]), pa.array(doc[to]), pa.array(line[to]), pa.array(key[root[on]])], [x.split()[0] for x in _FOUND.split(", ")])


#: Cells of up to so many sets are solved together, pair by pair.
FEW = 16


def _solved_few(both: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch | None:
    """Links inside many small cells at once; first is where the cell of each row begins."""
    s = Sets.of_words(both.column("words"))
    rank = np.arange(len(first)) - first
    i = np.concatenate([np.flatnonzero(rank >= d) for d in range(1, FEW)])
    j = i - np.repeat(np.arange(1, FEW), [int((rank >= d).sum()) for d in range(1, FEW)])
    near = np.minimum(s.sizes[i], s.sizes[j]) * 100 >= np.maximum(s.sizes[i], s.sizes[j]) * PERCENT
    i, j = i[near], j[near]
    # words of the smaller set are looked up among those of the larger one
    less = np.where(s.sizes[i] <= s.sizes[j], i, j)
    more = i + j - less
    n = s.sizes[less]
    pair = np.repeat(np.arange(len(i)), n)
    word = s.ids[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.starts[less], n)]
    flat = s.owner << ID_BITS | s.ids
    wanted = more[pair] << ID_BITS | word
    at = np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)
    common = np.bincount(pair[flat[at] == wanted], minlength=len(i))
    link = common * (100 + PERCENT) >= PERCENT * (s.sizes[i] + s.sizes[j])
    if not link.any():
        return None
    i, j = i[link], j[link]
    return _rows(both, np.concatenate([i, j]), np.concatenate([j, i]))


def _verified(batches):
    """_FOUND of all cells, which come one after the other, the left side first."""
    now, sides = None, ([], [])

    def out():
        left, right = (pa.Table.from_batches(x) if x else None for x in sides)
        return _solved_cell(left, right) if left is not None and (right is not None or now[2:4] == now[:2]) else None

    for b in batches:
        if not b.num_rows:
            continue
        cell = [b.column(c).to_numpy() for c in ("home", "c1", "b1", "c2", "b2", "side")]
        cuts = np.concatenate([[0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in cell], axis=0)) + 1, [b.num_rows]])
        width = np.diff(cuts)
        # whole cells of one side; those at the ends of a batch may go on beyond it
        few = (width <= FEW) & (cell[1][cuts[:-1]] == cell[3][cuts[:-1]]) & (cell[2][cuts[:-1]] == cell[4][cuts[:-1]])
        few[[0, -1]] = False
        on = np.repeat(few, width)
        if on.any():
            some = width[few]
            done = _solved_few(b.filter(pa.array(on)), np.repeat(np.cumsum(some) - some, some))
            if done is not None:
                yield done
        for k in np.flatnonzero(~few).tolist():
            s, e = int(cuts[k]), int(cuts[k + 1])
            key = (int(cell[1][s]), int(cell[2][s]), int(cell[3][s]), int(cell[4][s]), int(cell[0][s]))
            if key != now:
                if now is not None and (done := out()) is not None:
                    yield done
                now, sides = key, ([], [])
            sides[int(cell[5][s])].append(b.slice(s, e - s))
    if now is not None and (done := out()) is not None:
        yield done


def _linked_sets(members: DataFrame) -> DataFrame:
    """_FOUND of members(root, key, size, words, n, doc_id, line_no), sets whose candidates have one root. Up to CELL sets of a root are one
    cell. More are cut into classes of sizes, of which only neighbours can match, and those into blocks: each two blocks are a cell."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("of_root"))
    # sizes that match differ by a factor of 1.25 at most, so by one class at most
    rows = members.join(sizes, "root").withColumn("cls", F.when(F.col("of_root") <= CELL, F.lit(-1)).otherwise(F.floor(F.log("size") / F.log(F.lit(1.3))).cast("int")))
    units = materialise(rows.groupBy("root", "cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("blocks")), "units")
    rows = rows.join(units, ["root", "cls"]).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    one = units.select("root", F.col("cls").alias("c1"), F.col("blocks").alias("n1"))
    two = units.select("root", F.col("cls").alias("c2"), F.col("blocks").alias("n2"))
    cells = one.join(two, "root").where("c2 = c1 or (c1 >= 0 and c2 = c1 + 1)").withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
    cells = cells.where("c2 > c1 or b1 < n2").withColumn("b2", F.explode(F.sequence(F.when(F.col("c1") == F.col("c2"), F.col("b1")).otherwise(F.lit(0)), F.col("n2") - 1))).drop("n1", "n2")
    names = ["key", "words", "n", "doc_id", "line_no"]
    left = rows.join(cells.withColumns({"cls": F.col("c1"), "blk": F.col("b1")}), ["root", "cls", "blk"]).withColumn("side", F.lit(0))
    right = rows.join(cells.where("c1 <> c2 or b1 <> b2").withColumns({"cls": F.col("c2"), "blk": F.col("b2")}), ["root", "cls", "blk"]).withColumn("side", F.lit(1))
    cell = [F.col("root").alias("home"), "c1", "b1", "c2", "b2"]
    both = left.select(*cell, "side", *names).unionByName(right.select(*cell, "side", *names))
    order = ["home", "c1", "b1", "c2", "b2"]
    return both.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_verified, _FOUND)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, sets, found): lines(doc_id, line_no, key) of all lines with a word; sets(key, n, doc_id, line_no, size) with their first place;
    found, rows of _FOUND, which hold all links between different sets, each in one row for either end."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = materialise(base.mapInArrow(_lined, _LINES), "lines")
    worded = lines.where("words is not null").select("key", "size", "words")
    top = worded.select("words").mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(RANKED).toArrow()
    order = docs.sparkSession.sparkContext.broadcast(Order(top.column("word").to_numpy(), top.column("n").to_numpy()))
    each = lines.groupBy("key", "doc_id").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    firsts = materialise(each.groupBy("key").agg(F.sum("n").alias("n"), F.min_by("line_no", "doc_id").alias("line_no"), F.min("doc_id").alias("doc_id"), F.min("size").alias("size")), "firsts")
    roots = _candidates(worded.where(F.col("size") > SHORT), order).withColumnRenamed("node", "key")
    placed = materialise(roots.join(firsts.drop("size"), "key"), "placed")
    found = _linked_sets(materialise(worded.join(placed, "key").dropDuplicates(["key"]), "members"))
    small = firsts.where((F.col("size") >= 4) & (F.col("size") <= SHORT + 1)).select("key", F.struct("n", "doc_id", "line_no").alias("of_key"))
    short = worded.where((F.col("size") >= 5) & (F.col("size") <= SHORT + 1)).select("words").mapInArrow(_subsets, "key long, a long")
    short = short.join(small.withColumnsRenamed({"key": "a", "of_key": "of_a"}), "a").dropDuplicates(["key", "a"]).join(small, "key")
    low = F.least("key", "a").alias("to")
    sides = [short.select(F.col(me).alias("key"), F.col(f"{of}.n").alias("links"), F.col(f"{of}.doc_id").alias("doc_id"), F.col(f"{of}.line_no").alias("line_no"), low) for me, of in (("key", "of_a"), ("a", "of_key"))]
    return lines.select("doc_id", "line_no", "key"), firsts, materialise(found.unionByName(sides[0]).unionByName(sides[1]), "links")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: bool = False) -> DataFrame:
    """Lines that match another line: (doc_id, line_no, n_links, to_doc, to_line), and class_id if `classes`.

    A line's words are split at ASCII white space; lines match if the Jaccard similarity of their word sets is PERCENT / 100 or
    more. Blank lines take no part. All matches are found: candidates come from prefix, positional, length and bitmap
    filters, which lose no similar pair, and are verified by 40-bit word hashes. n_links counts the other lines that a line
    matches. to is the first of them if it stands before the line by (doc_id, line_no), else null. class_id is the smallest doc_id
    that holds a line which matches lead to. A null doc_id is _NULL_ID here.
    """
    return _matched(links(docs, id_col, text_col), classes)


def _matched(joined: tuple[DataFrame, DataFrame, DataFrame], classes: bool) -> DataFrame:
    lines, firsts, found = joined
    per = found.groupBy("key").agg(F.sum("links").alias("links"), F.min(F.struct("doc_id", "line_no")).alias("other"))
    known = firsts.withColumn("first", F.struct("doc_id", "line_no")).select("key", "n", "first").join(per, "key", "left").where("n > 1 or links is not null")
    if classes:
        roots = components(found.select(F.col("key").alias("u"), F.col("to").alias("v")))
        known = known.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        known = known.join(known.groupBy("root").agg(F.min("first.doc_id").alias("class_id")), "root")
    rows = lines.join(known.hint("shuffle_hash"), "key")  # a key of known has one row, so this side is even; lines may be skewed
    here = F.struct("doc_id", "line_no")
    to = F.when(here > F.least("first", F.coalesce("other", "first")), F.least("first", F.coalesce("other", "first")))
    n_links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    return rows.select("doc_id", "line_no", n_links, to["doc_id"].alias("to_doc"), to["line_no"].alias("to_line"), *(["class_id"] if classes else []))


def _plain_id(c):
    return F.when(c == F.lit(_NULL_ID), F.lit(None).cast("long")).otherwise(c)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_lines (with a word, over all rows of the id), n_links (other lines that its lines match, added up), n_removed (lines
    that match an earlier line), class_id (the smallest document that holds a line to which matches lead from one of its lines, itself if
    none), removed array<struct<line_no, first_doc_id, first_line_no>>.

    A null or blank text has no lines. Rows that repeat a doc_id share its lines' places, so they lose the same lines, and
    null ids count as one id, before all others (of class id null, as it would be the smallest); texts may be as long as a
    string column's rows, and a line of any number of words is compared whole; an empty table gives no rows; other columns
    are not read.
    """
    joined = links(docs, id_col, text_col)
    found = _matched(joined, classes=True)
    counts = joined[0].groupBy(F.col("doc_id").alias("_line_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    gone = F.col("to_line").isNotNull()
    per = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum("n_links").alias("n_links"), F.min("class_id").alias("class_id"),
        F.sort_array(F.collect_set(F.when(gone, F.struct("line_no", _plain_id(F.col("to_doc")).alias("first_doc_id"), F.col("to_line").alias("first_line_no"))))).alias("removed"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_key"))
    out = rows.join(counts, F.col("_key") == F.col("_line_id"), "left").join(per, F.col("_key") == F.col("_id"), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      _plain_id(F.coalesce("class_id", "_key")).alias("class_id"), "removed")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that an earlier line matches; all rows and columns stay, a document may end up empty. Nulls, blank and
    repeated rows as in line_dedup()."""
    gone = matches(docs, id_col, text_col).where("to_line is not null").groupBy(F.col("doc_id").alias("_netlens_id")).agg(F.collect_set("line_no").alias("_netlens_gone"))

    @F.arrow_udf("string")
    def left(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, lines in zip(texts, gone, strict=True):
            if lines.is_valid and text.is_valid:
                drop = set(lines.as_py())
                out.append("\n".join([x for i, x in enumerate(text.as_py().split("\n")) if i not in drop]))
            else:
                out.append(text.as_py())
        return pa.array(out, pa.string())

    joined = docs.join(gone, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)) == F.col("_netlens_id"), "left")
    changed = F.when(F.col("_netlens_gone").isNotNull(), left(F.col(f"`{text_col}`").cast("string"), F.col("_netlens_gone"))).otherwise(F.col(f"`{text_col}`"))
    return joined.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
