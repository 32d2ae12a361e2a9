"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import json
import random
import re
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.tokens import blocks

#: Words whose ids a Python worker remembers, and the longest such word in characters.
CACHE, CACHED_CHARS = 400_000, 64
#: Characters that may be cut into words here: Latin, without the sign of contractions.
_LATIN = [chr(c) for c in range(0x21, 0x250) if chr(c) != "'"]
#: What a rule of splitting at white space has to keep apart: letters, digits, signs, contractions, marks that combine, both sigmas.
_PROBES = ["a", "Ab1", "'s", "'", "s", "x'", "12", "!?", "́", "é", "Σ", "ΟΣ", "ß", "ᄀ", "ᅡ", " ", " b", "\x1c", "ͅ", "_", "½"]
_BREAKS = [" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n ", "  "]


class Codec:
    """A tokenizer's file as encoder and decoder.

    Text is normalised and cut into words by the file's own rules; each word's symbols are merged here. If those rules treat
    text between ASCII white space alone (tested when the file is loaded), words are looked up and merged once for each block
    of texts; otherwise every text goes through the rules whole. Latin letters, digits and signs are put into words by what the
    rules make of each character (tested, too), all else by the rules. Strings of added tokens become their ids.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int], suffix: str, joint: str, bytes_back: bool, rules):
        self.tokens = {i: t for t, i in {**vocab, **added}.items()}
        self.vocab, self.suffix, self.bytes_back, self.rules, self.added = vocab, suffix, bytes_back, rules, added
        self.size = max(self.tokens, default=-1) + 1
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merges[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.joint = joint.encode()
        self.strings = pa.array([self._bytes(i) + self.joint for i in range(self.size)], pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.by_word = all(rules(a + w + b) == rules(a) + rules(b) for a in _PROBES for b in _PROBES for w in _BREAKS)
        self.latin = self._latin() if self.by_word else None

    @classmethod
    def load(cls, path: str) -> Codec:
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, decoder, added = spec["model"], spec.get("decoder"), spec.get("added_tokens") or []
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: a kind of model that is not known here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens that take in what stands beside them are not known here")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"{path}: decoder {decoder['type']} is not known here")
        whole = tokenizers.Tokenizer.from_file(path)

        def rules(text: str) -> list[str]:
            text = whole.normalizer.normalize_str(text) if whole.normalizer else text
            return [w for w, _ in whole.pre_tokenizer.pre_tokenize_str(text)] if whole.pre_tokenizer else [text][:len(text)]

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in added}, model.get("end_of_word_suffix") or "", "" if decoder else " ", bool(decoder), rules)

    def _latin(self) -> tuple[re.Pattern, re.Pattern, dict[int, str]] | None:
        """(what is cut here, its words, what becomes of each character), or None if the rules see more than single characters."""
        rules, letters, digits, signs, to = self.rules, [], [], [], {}
        for c in _LATIN:
            made = rules(c)
            if len(made) != 1:
                continue
            m = made[0]
            kind = letters if rules(f"a{c}a") == [f"a{m}a"] else signs if rules(f"!{c}!") == [f"!{m}!"] else digits if rules(c + c + "a" + c) == [m, m, "a", m] else None
            if kind is not None:
                kind.append(c)
                to[ord(c)] = m
        if not (letters and digits and signs):
            return None
        a, b, c = (f"[{re.escape(''.join(k))}]" for k in (letters, digits, signs))
        whole, words = re.compile(f"[{re.escape(''.join([*letters, *digits, *signs]))}]+"), re.compile(f"{a}+|{b}|{c}+")
        rng = random.Random(0)
        tried = ["".join(rng.choice(rng.choice((letters, letters, digits, signs))) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
        return (whole, words, to) if all([w.translate(to) for w in words.findall(t)] == rules(t) for t in tried) else None

    def words(self, text: str) -> list[str]:
        """The words of a text, as the rules give them."""
        if self.latin and self.latin[0].fullmatch(text):
            to = self.latin[2]
            return [w.translate(to) for w in self.latin[1].findall(text)]
        return self.rules(text)

    def _bytes(self, i: int) -> bytes:
        token = self.tokens.get(i, "")
        if not self.bytes_back or token in self.added:
            return token.encode()
        return b"".join(bytes([_BYTE_OF[c]]) if c in _BYTE_OF else c.encode() for c in token)

    def merged(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges, the lowest rank first and of equal ranks the leftmost. A queue entry is stale, and skipped,
        if its symbol is gone or the pair that stands there now makes another token."""
        n, size, merges = len(symbols), self.size, self.merges
        if n < 2:
            return symbols
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for at in range(n - 1):
            m = merges.get(symbols[at] * size + symbols[at + 1])
            if m is not None:
                heap.append((m[0], at, m[1]))
        heapify(heap)
        while heap:
            _, at, new = heappop(heap)
            right = after[at]
            if symbols[at] < 0 or right >= n:
                continue
            m = merges.get(symbols[at] * size + symbols[right])
            if m is None or m[1] != new:
                continue
            symbols[at], symbols[right] = new, -1
            after[at] = end = after[right]
            left = before[at]
            if end < n:
                before[end] = at
                m = merges.get(new * size + symbols[end])
                if m is not None:
                    heappush(heap, (m[0], at, m[1]))
            if left >= 0:
                m = merges.get(symbols[left] * size + new)
                if m is not None:
                    heappush(heap, (m[0], left, m[1]))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of a word, little-endian; words seen before are looked up."""
        ids = self.known.get(word)
        if ids is None:
            vocab = self.vocab
            symbols = [vocab.get(c) for c in word]
            if self.suffix:
                symbols[-1] = vocab.get(word[-1] + self.suffix)
            ids = np.array(self.merged([s for s in symbols if s is not None]), dtype="<u4").tobytes()
            if len(word) <= CACHED_CHARS:
                self.known[word] = ids
                if len(self.known) > CACHE:  # the oldest go
                    for w in list(islice(self.known, CACHE // 4 + 1)):
                        del self.known[w]
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        return b"".join([self._word(w) for w in self.words(text)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        parts, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            parts += [self._plain(text[at:m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[at:])]), dtype="<u4")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin, and the end). A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.ones(len(texts), dtype=bool)
        if self.by_word:
            odd[:] = False
            for token in self.added:
                odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        alone = {i: self.encode(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        if alone:
            texts = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = [self._plain(w) for w in coded.dictionary.to_pylist()]
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        begin, which = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        out = flat[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])]
        edges = ends[np.asarray(words.offsets.to_numpy(), dtype=np.int64) - words.offsets[0].as_py()]
        if alone:
            rows = list(alone)
            sizes = np.zeros(len(texts) + 1, dtype=np.int64)
            sizes[np.array(rows) + 1] = [len(alone[i]) for i in rows]
            out = np.insert(out, np.repeat(edges[rows], [len(alone[i]) for i in rows]), np.concatenate([alone[i] for i in rows]))
            edges = edges + np.cumsum(sizes)
        return out, edges

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The text of each range of ids, in UTF-8: vocabulary strings put together, with what joins them. Ids beyond the vocabulary
        are nothing, as in the library."""
        ids = np.asarray(ids, dtype=np.int64)
        if self.joint or len(ids) and ids.max() >= self.size:
            real = (ids >= 0) & (ids < self.size)
            real[real] = np.array([int(i) in self.tokens for i in range(self.size)], dtype=bool)[ids[real]] if len(self.tokens) < self.size else True
            if not real.all():
                edges, ids = np.concatenate([[0], np.cumsum(real)])[edges], ids[real]
        got = self.strings.take(pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], dtype=np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        data, cut = memoryview(got.buffers()[2] or b""), len(self.joint)
        out = [bytes(data[offsets[a]:offsets[b] - cut]) if b > a else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [x.decode("utf-8", "replace").encode() for x in out] if self.bytes_back else out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE_OF = _byte_letters()
_LOADED: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The codec of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return _LOADED[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row, whole texts. A null text gives null, an empty one no ids; repeated rows get a row each,
    an empty table gives none, and other columns are not read. A text lies in one task; merging takes n log n of its longest word."""

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for b in blocks(batch):
                ids, edges = codec.encode_all(b.column(1))
                rows = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(b.column(1).is_valid(), rows, pa.scalar(None, rows.type))], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids. Null gives null, no ids an empty text; null ids and ids beyond the vocabulary are left out."""

    def run(batches):
        codec = codec_of(path)
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
            texts = codec.decode_all(np.where(ids < 0, codec.size, ids), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(lists.is_valid(), pa.array(texts, pa.binary()).cast(pa.string()), pa.scalar(None, pa.string()))], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (the text that the
    ids decode to, UTF-8), both as lower-case hex.

    A null text counts as empty: no tokens, hashes of nothing. Repeated rows get a row each, a null doc_id stays null, an empty
    table gives no rows; other columns are not read. Texts are encoded whole, in blocks of some 4 MB, a longer one alone.
    """

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for b in blocks(batch):
                ids, edges = codec.encode_all(b.column(1))
                hashed = [hashlib.sha256(ids[s:e]).hexdigest() for s, e in zip(edges[:-1], edges[1:], strict=True)]
                back = [hashlib.sha256(t).hexdigest() for t in codec.decode_all(ids, edges)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(edges)), pa.array(hashed), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
