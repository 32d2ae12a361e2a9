"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.tokens import blocks

#: n-grams are hashed into 2**BITS buckets.
BITS = 16
SIZES = (1, 2, 3)
#: Labelled documents that training reads for each language, spread over all of them by a hash of the text; the bound of the sample.
TRAIN_DOCS = 20_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of a long text, and n-grams of a batch, that are worked on at once.
BLOCK, SCORED = 1 << 18, 1 << 20
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _pieces(text: str):
    """A long text in blocks that end at a blank, if there is one."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
            end = end if end > at else at + BLOCK
        yield text[at:end]
        at = end


def gram_blocks(text: str):
    """Buckets of a text's character 1-, 2- and 3-grams, lower-cased, runs of anything but letters as one blank, one block after the
    other: n-grams across blocks are those of the whole text."""
    before, held = True, np.array([32], dtype=np.uint32)
    fresh = 1  # codes of `held` that have not been 1-grams yet
    for piece, is_last in _ended(_pieces(text)):
        c = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters(c)
        c = np.where(letter, c, np.uint32(32))[letter | np.concatenate([[before], letter[:-1]])] if len(c) else c
        before = bool(letter[-1]) if len(letter) else before
        codes = np.concatenate([held, c, np.array([32] if is_last else [], dtype=np.uint32)]).astype(np.uint32)
        old = len(held) - fresh
        out = []
        for n in SIZES:
            x = codes[max(0, old - n + 1):]
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, n, dtype=np.uint32) * np.uint32(0x27D4EB2F)
            for k in range(n):
                h = (h ^ x[k:len(x) - n + 1 + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
        yield np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        held, fresh = codes[-(max(SIZES) - 1):], 0


def _ended(items):
    """Each item with whether it is the last; an empty iterator gives one empty text."""
    items = iter(items)
    now = next(items, "")
    for following in items:
        yield now, False
        now = following
    yield now, True


def grams(text: str) -> np.ndarray:
    return np.concatenate(list(gram_blocks(text)))


_LETTER = np.zeros(0x110000, dtype=bool)


def _letters(c: np.ndarray) -> np.ndarray:
    """Which code points are letters, by a table that is made once in each worker."""
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER[c]


def _counted(languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), 1 << BITS), dtype=np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for some in gram_blocks(text.as_py() or ""):
                    counts[at[lang]] += np.bincount(some, minlength=1 << BITS)
        row, bucket = np.nonzero(counts)
        for k in range(0, len(row), 65536):
            r, c = row[k:k + 65536], bucket[k:k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[r, c])], ["lang", "bucket", "n"])

    return run


class Model:
    """languages, and log-probabilities as float32 [bucket, language]: 256 kB for each language that is broadcast."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray):
        self.languages, self.logs, self.priors = languages, logs, priors

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Log-probabilities [text, language]: sparse counts of n-grams, a batch of them at a time, times the matrix."""
        out = np.tile(self.priors, (len(texts), 1))
        held, n = [], 0

        def add():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            row = keys >> BITS
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for k in range(0, len(first), 4096):  # rows of some of the texts, so that products stay small
                s, e = int(first[k]), int(first[k + 4096]) if k + 4096 < len(first) else len(keys)
                product = self.logs[keys[s:e] & ((1 << BITS) - 1)].astype(np.float64) * times[s:e, None]
                out[row[first[k:k + 4096]]] += np.add.reduceat(product, first[k:k + 4096] - s, axis=0)

        for i, text in enumerate(texts):
            for some in gram_blocks(text or ""):
                held.append(some.astype(np.int64) | i << BITS)
                n += len(some)
                if n > SCORED:
                    add()
                    held, n = [], 0
        if held:
            add()
        return out

    def predictions(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and posteriors; `und` and 0 without a letter or without a model. Ties go to the first language by name."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = self.totals(texts)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
        seen = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), seen, strict=True)], [x if ok else 0.0 for x, ok in zip(score.tolist(), seen, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        languages, scores = self.predictions([text])
        return languages[0], scores[0]


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most_docs: int = TRAIN_DOCS) -> Model:
    """A model from rows with a non-null language and text.

    Of a language with more than `most_docs` rows a share is read, chosen by a hash of the text, so that about most_docs
    remain; counts of n-grams are added up in Spark, and the driver gets the sums: 2**BITS for each language at most. All
    languages are learnt, each with a prior of all its rows.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, most_docs / n)))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * F.lit(1 << 20))
    sums = chosen.mapInArrow(_counted(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BITS, len(languages)))
    counts[sums.column("bucket").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
    counts += SMOOTHING
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    n = np.array([sizes[x] for x in languages], dtype=np.float64)
    return Model(languages, logs, np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; only the text counts. Null, empty and letterless texts are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for block in blocks(b):
                languages, scores = model.predictions(block.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """A third of the documents: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the model learns from the rows that are not held out and predicts all of them.

    Texts of any length are scored whole. Repeated rows get a row each; a table without labels gives `und` everywhere; other columns are not read.
    """
    model = train(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    said = predict(docs, model, id_col, text_col)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
