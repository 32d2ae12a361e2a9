"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Chunks of text whose ids a Python worker remembers.
CACHE = 150_000
_RUNS = re.compile(r" *[^ ]+| +")


class Pieces:
    """A model's pieces, as encoder and decoder.

    kind "unigram": the best sum of piece scores. kind "bpe": the model's scores order merges, and a piece may follow another
    only if merging both texts afresh gives the same two pieces; every prefix of a text then has one last piece, which the
    pass finds among the pieces that end there, longest first. Both relax one value for each position in a single pass over
    what the automaton reports, output links included. Characters without a piece become their UTF-8 bytes' pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unknown: int, kind: str = "bpe", cache: int = CACHE):
        import ahocorasick

        self.pieces, self.scores, self.kind, self.unknown, self.most = pieces, scores, kind, unknown, cache
        self.byte_ids = byte_ids
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.characters = {p for p in self.id_of if len(p) == 1}
        back = {i: b for b, i in byte_ids.items()}
        self.bytes = [bytes([back[i]]) if i in back else b" \xe2\x81\x87 " if i == unknown else b"" if i in special else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, model_path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], special, byte_ids, sp.unk_id(), kind)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32 bytes. No piece has a blank behind another character, so a text falls into chunks
        there, and a chunk that is known needs no second pass."""
        if not text:
            return b""
        text = text.replace(BLANK, " ")  # the model knows no difference
        known, chunks = self.known, text.split(" ")
        if "" in chunks:
            chunks = [c[1:] for c in _RUNS.findall(" " + text)]  # a chunk keeps all blanks before it, but the one that every chunk has
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = self._chunk(BLANK + c.replace(" ", BLANK))
        out = b"".join([known[c] for c in chunks])
        if len(known) > self.most:
            for c in list(islice(reversed(known), len(known) - self.most * 3 // 4)):
                del known[c]
        if len(self.follows) > 4 * self.most:
            self.follows.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding puts before it goes."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _chunk(self, chunk: str) -> bytes:
        ids, at, characters = [], 0, self.characters
        for i, c in enumerate(chunk):
            if c not in characters:
                ids += self._pass(chunk[at:i])
                ids += [self.byte_ids.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
                at = i + 1
        ids += self._pass(chunk[at:])
        return np.array(ids, dtype="<u4").tobytes()

    def _pass(self, text: str) -> list[int]:
        if not text:
            return []
        if text in self.id_of and self.kind == "bpe" and len(text) == 1:
            return [self.id_of[text]]
        last, came = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        if self.kind == "bpe":
            follows = self.follows
            for end, (piece, n) in self.automaton.iter(text):
                if last[end + 1] < 0:
                    start = end + 1 - n
                    if start:
                        pair = (last[start], piece)
                        ok = follows.get(pair)
                        if ok is None:
                            ok = follows[pair] = self.merged(self.pieces[pair[0]] + self.pieces[piece]) == [pair[0], piece]
                        if not ok:
                            continue
                    last[end + 1], came[end + 1] = piece, start
        else:
            best = [0.0] + [-np.inf] * len(text)
            scores = self.scores
            for end, (piece, n) in self.automaton.iter(text):
                score = best[end + 1 - n] + scores[piece]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1], came[end + 1] = score, piece, end + 1 - n
        ids, at = [], len(text)
        while at:
            if last[at] < 0:  # equal scores among merges: the pass found no stable pair
                return self.merged(text)
            ids.append(last[at])
            at = came[at]
        return ids[::-1]

    def merged(self, text: str) -> list[int]:
        """Merging by the rule itself: of all neighbours whose joined text is a piece the best-scored, leftmost pair first."""
        parts, id_of, scores = list(text), self.id_of, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                return [id_of[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]


_LOADED: dict[tuple[str, str], Pieces] = {}


def pieces_of(path: str, kind: str) -> Pieces:
    """The model of this Python worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Pieces.load(path, kind)
    return _LOADED[path, kind]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """(doc_id, ids array<int>) of each row. A null text gives null, an empty one no ids; other columns are not read."""

    def run(batches):
        model = pieces_of(model_path, kind)
        for b in batches:
            ids = [None if not t.is_valid else np.frombuffer(model.encode(t.as_py()), dtype="<i4") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of each row of ids; null gives null. Ids that are no piece are an error."""

    def run(batches):
        model = pieces_of(model_path, kind)
        for b in batches:
            texts = [None if not x.is_valid else model.decode(x.values.to_numpy()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """One row for each document: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text back).

    A null text counts as empty: no ids, crc 0, round trip true. Repeated rows get a row each; an empty table gives no rows.
    """

    def run(batches):
        model = pieces_of(model_path, kind)
        for b in batches:
            n, crc, same = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                raw = model.encode(text)
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                same.append(model.decode(np.frombuffer(raw, dtype="<u4")) == text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
