"""Packing documents into training sequences: bounded-space best fit in each partition, leftovers merged in rounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialise, tidy
from netlens.llm.tokens import blocks, tokens

LENGTH = 2048
#: Windows that a partition keeps open.
OPEN = 32
END_ID = 1
#: The table of words that a Python worker remembers has 2**TABLE_BITS slots of 25 bytes.
TABLE_BITS = 20
#: Punctuation that is split off the end of a word.
CLOSING = ".,;:!?"
#: Partitions whose leftovers one task merges in a round.
FAN_IN = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, done boolean, part long"


class Encoder:
    """Ids of whole columns of texts by a tokenizer for which white space ends every token.

    A word (what stands between ASCII white space) then has the same ids wherever it stands. Words are hashed in numpy and looked up in a
    table of 2**bits slots, each with the ids of the word that came last; words that are not there are encoded once for each
    column, many at a time with a separator between them. Words of more than `most` ids or 64 bytes are encoded anew in each
    column. The rule is tested when a tokenizer is loaded: where it does not hold, texts are encoded whole. Two more rules are
    tested and used if they hold: that A-Z count as a-z, and that CLOSING punctuation after a letter or digit is a token of its own.
    """

    SEPARATOR = "\x00"
    PROBES = ("Hello, World!", "a'b", "it's", "1234", "x" * 40, "Ünï", "…", "<|endoftext|>", "don't.", "-", "字漢", "\u0301e", "e\u0301", "Σ", "ΣΑΣ", "\xa0a\xa0", "a\u2028b", "9th", "</w>")

    def __init__(self, tokenizer_path: str, bits: int = TABLE_BITS, most: int = 8):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_path), most
        self.hashes, self.sizes = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint8)
        wide = max(self.tokenizer.get_vocab().values()) >= 1 << 16
        self.ids = np.zeros((1 << bits, most), dtype=np.uint32 if wide else np.uint16)
        mark = self._whole(self.SEPARATOR)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = self._holds()
        plain = [x for x in (*self.PROBES, "I", "Don't", "WORD'S", "Abc9", "A1B2") if x.isascii() and x[-1].isalnum()]
        self.lowers = all(np.array_equal(self._whole(x), self._whole(x.lower())) for x in (*plain, *map(str.upper, plain)) if "<" not in x)
        closes = all(np.array_equal(self._whole(x + c), np.concatenate([self._whole(x), self._whole(c)])) for x in (*plain, *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for c in CLOSING)
        self.closing = CLOSING.encode() if closes else b""

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _holds(self) -> bool:
        for blank in " \t\n\x0b\x0c\r":
            for a in self.PROBES:
                for b in (*self.PROBES[:8], a):
                    if not np.array_equal(self._whole(f"{blank}{a}{blank}{blank}{b}{blank}"), np.concatenate([self._whole(a), self._whole(b)])):
                        return False
        return True

    def _has_special(self, data: bytes) -> bool:
        return any(x in data for x in self.special)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(words), 512):
            some = words[k:k + 512]
            if self.mark is not None:
                ids = self._whole(f" {self.SEPARATOR} ".join(some))
                at = np.flatnonzero(ids == self.mark)
                if len(at) == len(some) - 1:
                    edges = [-1, *at.tolist(), len(ids)]
                    out += [ids[s + 1:e] for s, e in zip(edges, edges[1:], strict=False)]
                    continue
            out += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, each text's followed by end_id; where each text begins, and the end). A null text is empty."""
        if not self.by_word:
            each = [np.append(self._whole(t.as_py()) if t.is_valid else np.zeros(0, dtype=np.uint32), np.uint32(end_id)).astype(np.uint32) for t in texts]
            return np.concatenate([*each, np.zeros(0, dtype=np.uint32)]), np.cumsum([0, *map(len, each)])
        t = tokens(texts, lower=self.lowers, lines=False, closing=self.closing)
        if self.lowers and self._has_special(t.data.tobytes()):
            t = tokens(texts, lines=False, closing=self.closing)  # a special token is told from its other spellings
        slot = (t.hashes & np.uint64(len(self.hashes) - 1)).astype(np.int64)
        sizes, at = self.sizes[slot].astype(np.int64), slot * self.most
        missed = np.flatnonzero((self.hashes[slot] != t.hashes) | (sizes == 0))
        extra = np.zeros(0, dtype=np.uint32)
        if len(missed):
            # a long word is told by its place: of those no hash is trusted
            width = (t.ends - t.starts)[missed]
            short, long = missed[width <= 64], missed[width > 64]
            _, first, back = np.unique(t.hashes[short], return_index=True, return_inverse=True)
            new, missed = np.concatenate([short[first], long]), np.concatenate([short, long])
            back = np.concatenate([back, len(first) + np.arange(len(long))])
            made = self._encoded([t.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(t.starts[new].tolist(), t.ends[new].tolist(), strict=True)])
            n = np.array([len(x) for x in made], dtype=np.int64)
            extra, begin = np.concatenate(made), np.cumsum(n) - n
            sizes[missed], at[missed] = n[back], (self.ids.size + begin)[back]
        edges = np.concatenate([[0], np.cumsum(np.bincount(t.rows, weights=sizes, minlength=len(texts)).astype(np.int64) + 1)])
        place = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        known = place < self.ids.size
        flat = np.empty(len(place), dtype=np.uint32)
        flat[known], flat[~known] = self.ids.ravel()[place[known]], extra[place[~known] - self.ids.size]
        goes = np.ones(edges[-1], dtype=bool)
        goes[edges[1:] - 1] = False
        out = np.full(edges[-1], end_id, dtype=np.uint32)
        out[goes] = flat
        if len(missed):
            keep = (n > 0) & (n <= self.most) & ((t.ends - t.starts)[new] <= 64)
            for k in range(self.most):
                on = np.flatnonzero(keep & (n > k))
                self.ids[slot[new[on]], k] = extra[begin[on] + k]
            self.hashes[slot[new[keep]]], self.sizes[slot[new[keep]]] = t.hashes[new[keep]], n[keep]
        return out, edges


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its tables serve all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Open windows of a partition. A window is [used, pieces]; a piece goes to the fullest window that can hold it, and
    if none can, the fullest window is closed to make room."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most, self.windows, self.closed = length, open_windows, [], []

    def place(self, size: int, pieces: list) -> None:
        fits = [w for w in self.windows if w[0] + size <= self.length]
        if fits:
            w = max(fits, key=lambda w: w[0])
            w[0] += size
            w[1] += pieces
        else:
            if len(self.windows) >= self.most:
                self.close(max(self.windows, key=lambda w: w[0]))
            w = [size, list(pieces)]
            self.windows.append(w)
        if w[0] == self.length:
            self.close(w)

    def close(self, w: list) -> None:
        self.windows = [x for x in self.windows if x is not w]
        self.closed.append(w)


class _Out:
    """Rows of PIECES, with sequence ids of this partition and round."""

    def __init__(self, first: int, part: int):
        self.next, self.part, self.rows = first, part, []

    def add(self, window: list, done: bool) -> None:
        at = 0
        for p in window[1]:
            self.rows.append((*p, self.next, at, done, self.part))
            at += p[2]
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in range(9)]
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


def _first_round(path: str, length: int, open_windows: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        encode, packer, out = encoder(path), Packer(length, open_windows), _Out(part << 32, part)
        for b in batches:
            for block in blocks(b):
                ids, edges = encode(block.column(1), END_ID)
                raw = memoryview(ids.astype("<u4").tobytes())
                for doc, begin, end in zip(block.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    n = end - begin
                    # whole windows first, the rest is one piece; a document of up to the length stays whole
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        at = 4 * (begin + start)
                        packer.place(size, [(doc, start, size, zlib.crc32(raw[at:at + 4 * size]), n)])
                    for w in packer.closed:
                        out.add(w, True)
                    packer.closed.clear()
                if len(out.rows) > 8192:
                    yield out.batch()
        for w in packer.windows:
            out.add(w, w[0] == length)
        yield out.batch()

    return run


def _merge_round(length: int, open_windows: int, round_no: int, fan_in: int, last: bool):
    def run(batches):
        group, packer, out = None, None, None

        def end():
            for w in packer.closed + packer.windows:
                out.add(w, last or w[0] == length)

        for b in batches:
            for *piece, _, _, _, part in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part // fan_in != group:
                    if packer is not None:
                        end()
                        yield out.batch()
                    group = part // fan_in
                    packer, out = Packer(length, open_windows), _Out(group << 32 | round_no << 26, group)
                packer.place(piece[2], [tuple(piece)])
                for w in packer.closed:
                    out.add(w, True)
                packer.closed.clear()
            if out is not None and len(out.rows) > 8192:
                yield out.batch()
        if packer is not None:
            end()
            yield out.batch()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         open_windows: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` ids.

    A document is its ids and then id 1; a null or empty text is that id alone, one piece. Whole windows are cut off the
    front of a long document, the rest is placed best-fit into one of `open_windows` open windows of the partition, and
    the fullest window is closed when none fits. Windows still open at the end of a partition are leftovers: rounds
    merge those of `fan_in` partitions each by the same rule until one partition is left, so no task ever holds more
    than the windows of fan_in partitions. Repeated rows are packed once each; other columns are not read.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. sequence_id is unique, with gaps.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = materialise(base.mapInArrow(tidy(_first_round(tokenizer_path, length, open_windows)), PIECES), "packed")
    out, open_rows, round_no = done.where("done"), done.where("not done"), 0
    while True:
        most = open_rows.agg(F.max("part")).first()[0]
        if most is None:
            break
        round_no += 1
        last = most < fan_in
        group = (F.col("part") / F.lit(fan_in)).cast("long")
        merged = (open_rows.repartition(group).sortWithinPartitions(group, F.desc("length"), "doc_id", "start", "sequence_id")
                  .mapInArrow(_merge_round(length, open_windows, round_no, fan_in, last), PIECES))
        merged = materialise(merged, "packed")
        out, open_rows = out.unionByName(merged.where("done")), merged.where("not done")
        if last:
            break
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer_path: str, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>, doc_starts array<int>), padded to `length` unless the
    number of ids is a power of two. A window's pieces meet in one row, at most `length` ids of them. doc_id must be unique."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        encode = encoder(tokenizer_path)
        for b in batches:
            flat, edges = encode(b.column(1), END_ID)
            at = edges[:-1] + b.column(2).to_numpy()
            ids = [flat[s:s + n].astype(np.int32) for s, n in zip(at.tolist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    cuts = (pieces.join(text, "doc_id").select("sequence_id", "text", "start", "length", "offset")
            .mapInArrow(cut, "sequence_id long, offset long, ids array<int>"))
    rows = cuts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    whole = n.bitwiseAND(n - 1) == 0
    return rows.select("sequence_id", F.when(whole, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - n))).alias("ids"),
                       F.col("p.offset").cast("array<int>").alias("doc_starts"))
