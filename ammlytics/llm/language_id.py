"""Language identification by bit-sliced Bloom filters of character n-grams.

Text is lower-cased code point by code point; runs of other characters than letters become one blank. For each n-gram size the
n-grams that are frequent in a language's training texts go into that language's Bloom filter; the filters of all languages
are bit slices of one table, so that ``HASHES`` lookups and one AND give a bitmask of all languages that contain an n-gram.
A text's counts by language (popcounts over its n-grams), corrected for each filter's false positives, decide: the language with the
largest corrected share, the first in order of name among equal ones.

Training counts n-grams over a bounded sample: of each language about ``train_docs`` labelled texts, chosen by a hash of doc_id
(whole texts), all if there are fewer. Prediction sees nothing but the text.

Rows. Null text, or text without a letter: ``und``, score 0. With nothing to learn from, every text is ``und``. Rows are
independent; a text with letters but no known n-gram gets the language with most training texts, score 0.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ammlytics.llm import _arrays as A
from ammlytics.llm._bpe import LETTER, point_classes
from ammlytics.llm._spark import texts, written

U64 = np.uint64
SIZES = (2, 3, 4)
HASHES = 3
#: Slots of the table: a fixed size of 8 bytes each for every 64 languages.
SLOT_BITS = 20
UNKNOWN = "und"
#: Text that a task works on at a time, and n-grams that it holds before it adds them up: these bound its memory.
CHUNK_BYTES, COUNT_GRAMS = 1 << 19, 2_000_000


@cache
def _folded() -> np.ndarray:
    """Each code point's lower-case letter; 32 for what is no letter."""
    low = np.full(0x110000, 32, np.uint32)
    for p in np.flatnonzero(point_classes() == LETTER).tolist():
        x = chr(p).lower()
        low[p] = ord(x) if len(x) == 1 else p
    return low


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each size a hash of every n-gram (0 where one leaves its document), the documents' bounds, and which have letters."""
    points, at = A.code_points(data, offsets)
    x = _folded()[points]
    letters = np.concatenate(([0], np.cumsum(x != 32)))
    lettered = letters[at[1:]] > letters[at[:-1]]
    x = np.append(np.insert(x, at[:-1], 32), np.uint32(32))  # a blank before each document and at the end
    edge = at + np.arange(len(at))
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[0] = True
    bounds = np.cumsum(keep)[edge] - 1
    y = x[keep].astype(U64)
    out = []
    for n in SIZES:
        h = A.gram_hashes(y, n) | U64(1)
        for back in range(1, n - 1):
            gone = bounds[1:] - back
            h[gone[(gone >= 0) & (gone < len(h))]] = 0
        h = np.concatenate((h, np.zeros(len(y) - len(h), U64)))
        out.append(h)
    return out, bounds, lettered


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> U64(64 - SLOT_BITS * (i + 1))) & U64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The bit-sliced table of all languages."""

    def __init__(self, languages: list[str], keys: list[np.ndarray], default: int):
        self.languages, self.default = languages, default
        self.table = np.zeros((-(-max(1, len(languages)) // 64), 1 << SLOT_BITS), U64)
        for i, k in enumerate(keys):
            for s in _slots(k):
                self.table[i // 64, np.unique(s)] |= U64(1 << i % 64)
        fill = np.array([np.count_nonzero(self.table[i // 64] & U64(1 << i % 64)) / (1 << SLOT_BITS) for i in range(len(languages))])
        self.false = fill**HASHES

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each document's n-grams that each language contains; which documents have letters."""
        n = len(offsets) - 1
        hit, total = np.zeros((n, len(self.languages))), np.zeros(n)
        sizes, bounds, lettered = grams(data, offsets)
        last = np.append(bounds[:-1], bounds[-1])
        for h in sizes:
            slots = _slots(h)
            real = h != 0
            total += np.diff(np.concatenate(([0], np.cumsum(real)))[last])
            for plane, row in enumerate(self.table):
                mask = row[slots[0]]
                for s in slots[1:]:
                    mask &= row[s]
                mask[~real] = 0
                for i in range(plane * 64, min(len(self.languages), plane * 64 + 64)):
                    hit[:, i] += np.diff(np.concatenate(([0], np.cumsum((mask >> U64(i % 64)) & U64(1), dtype=np.int64)))[last])
        share = hit / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1), lettered


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], schema=schema)

    for langs, data, offsets in A.chunks(batches, 2, CHUNK_BYTES):
        names = langs.to_pylist()
        found, bounds, _ = grams(data, offsets)
        for lang in set(names):
            mine = [i for i, x in enumerate(names) if x == lang]
            for h in found:
                part = np.concatenate([h[bounds[i] : bounds[i + 1]] for i in mine])
                held.setdefault(lang, []).append(part[part != 0])
                size += len(part)
        if size > COUNT_GRAMS:
            yield from out()
            held, size = {}, 0
    yield from out()


def fit(labelled: DataFrame, *, train_docs: int = 4000, keep: int = 150_000, least: float = 2e-6, rarer: float = 0.1) -> Filters:
    """Filters from labelled(doc_id, text, lang). keep: most frequent n-grams of a language that are held (a fixed bound, sent to the driver and to all tasks). least: least share of a language's n-grams. rarer: least ratio to the share that the n-gram has in any other language."""
    rows = texts(labelled, "doc_id", "lang", "text").where("lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], [], 0)
    share = F.create_map([F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs / counts[lang]))])
    chosen = rows.where(F.expr("pmod(xxhash64(doc_id, 'train'), 1000000)") < share[F.col("lang")] * 1_000_000).select("lang", "text")
    total = written(chosen.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).where("c > 2"))
    keys = []
    table = total.groupBy("lang").agg(F.sum("c").alias("all"))
    often = total.join(F.broadcast(table), "lang").where(F.col("c") >= F.col("all") * least).select("lang", "gram", "c", (F.col("c") / F.col("all")).alias("rate"))  # a row for each language
    # what is much rarer here than in another language comes from quoted or mislabelled text
    best = often.groupBy("gram").agg(F.max("rate").alias("best"))
    often = written(often.join(best, "gram").where(F.col("rate") >= rarer * F.col("best")).select("lang", "gram", "c"))
    for lang in languages:
        top = often.where(F.col("lang") == lang).orderBy(F.desc("c"), "gram").limit(keep).select("gram").toArrow()
        keys.append(top["gram"].to_numpy().view(U64))
    return Filters(languages, keys, max(range(len(languages)), key=lambda i: (counts[languages[i]], -i)))


def predict(docs: DataFrame, filters: Filters, *carry: str) -> DataFrame:
    """Of docs(doc_id, text): doc_id, lang_pred, score (the corrected share of the language's n-grams) and the columns named in carry."""
    model = docs.sparkSession.sparkContext.broadcast(filters)
    base = texts(docs, "doc_id", *carry, "text")
    kinds = dict(base.dtypes)
    columns = ["doc_id", *carry]

    def run(batches):
        f = model.value
        for *lead, data, offsets in A.chunks(batches, len(columns) + 1, CHUNK_BYTES):
            n = len(offsets) - 1
            if not f.languages:
                names, score = [UNKNOWN] * n, np.zeros(n)
            else:
                share, lettered = f.shares(data, offsets)
                best = share.argmax(1)
                score = share[np.arange(n), best] * lettered
                best[score == 0] = f.default
                names = [f.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*lead, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    return base.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double")


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
