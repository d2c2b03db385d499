"""SentencePiece encoding and decoding with seeded merge-dropout.

A piece model of merge (BPE) type is read from its file. Text becomes pieces as the model says: a blank becomes the mark U+2581, one more
mark stands in front, characters without a piece of their own become bytes. Candidate merges are taken from an agenda, best score first,
leftmost among equals. With ``dropout`` p, a candidate is skipped when a keyed hash of (seed, doc_id, place of the word in its document, span
in the word, the piece it would make) falls below p: the same document and seed always give the same segmentation, each occurrence of a
word its own, and all decode to the same text.

Merges never cross from a character to a following mark (no piece of such a model does), so words are segmented for themselves, all words
of one length together. Each distinct word of a chunk is segmented once without dropout. Where an occurrence skips none of the merges
made there, its agenda would run the same way, so it takes that segmentation; only the other occurrences are run again with their keys.

Rows. Null text is empty: no ids. Decoding gives the text back exactly. Repeated rows (same doc_id and text) give repeated results. A text of any length is
encoded whole.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ammlytics.llm import _arrays as A
from ammlytics.llm._bpe import PairTable, expand, merge_many
from ammlytics.llm._spark import texts

U64 = np.uint64
MARK = "▁"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model file, merges among them, and ids of characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.texts) if plain[i]}
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = model.unk_id()
        order = sorted(self.id.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[i], i)
        self.table = PairTable(pairs)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.raw = self._raw(plain)

    def _raw(self, plain: list[bool]) -> list[bytes]:
        raw = [t.replace(MARK, " ").encode() if ok else b"" for t, ok in zip(self.texts, plain, strict=True)]
        for b, i in enumerate(self.byte_id.tolist()):
            raw[i] = bytes([b])
        return raw

    def encode(self, data: np.ndarray, offsets: np.ndarray, dropout: float, seed: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, flat, and each document's offset. docs: a number for each document, which keys its dropout."""
        points, at = A.code_points(data, offsets)
        full = np.flatnonzero(np.diff(at) > 0)
        x = np.insert(points, at[:-1][full], 32)  # a mark before each document that has text
        added = np.zeros(len(at), np.int64)
        added[1:] = np.cumsum(np.diff(at) > 0)
        at = at + added
        x = np.where(x == 32, np.uint32(ord(MARK)), x)
        n = len(x)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = np.zeros(n, bool)
        mark = x == ord(MARK)
        start[0] = True
        start[1:] = mark[1:] & ~mark[:-1]
        start[at[:-1][at[:-1] < n]] = True
        # characters without a piece stand for their bytes, which never merge: as symbols of their own
        ids = self.char[x]
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, n))
        sums = np.zeros(n + 1, U64)
        np.cumsum(A.mix(x.astype(U64)) * A.powers(A.BASE, n), out=sums[1:], dtype=U64)
        word = A.mix((sums[begin + size] - sums[begin]) * A.powers(A.BASE_INV, n + 1)[begin])
        _, pick, which = np.unique(word, return_index=True, return_inverse=True)
        made: list[tuple] = []
        flat, off = self._merged(ids, x, begin[pick], size[pick], None, (lambda *m: made.append(m)) if dropout else None)
        if dropout:
            least = U64(min(int(dropout * 2**64), 2**64 - 1))
            owner = np.searchsorted(at, begin, side="right") - 1
            key = A.mix(A.mix(docs.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % 2**64))[owner] + (begin - at[owner]).astype(U64))
            changed = np.flatnonzero(self._hit(key, which, made, len(pick), least))
            if len(changed):
                again = key[changed]
                other, place = self._merged(ids, x, begin[changed], size[changed], lambda rows, *span: A.mix(again[rows] ^ _span(*span)) < least, None)
                flat, off = np.concatenate((flat, other)), np.concatenate((off, place[1:] + off[-1]))
                which = which.copy()
                which[changed] = len(pick) + np.arange(len(changed))
        out, place = expand(flat, off, which)
        return out, place[np.searchsorted(begin, at)]

    def _merged(self, ids, points, begin, size, dropped, made):
        """Segmentation of the words at the given places: ids, flat, and each word's offset."""
        first = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(begin - first[:-1], size) + np.arange(first[-1])
        mine = ids[source]
        flat, off = merge_many(np.where(mine < 0, 0xFFFF, mine), first, self.table, dropped, made)
        return self._bytes(flat, off, points[source], first) if (mine < 0).any() else (flat, off)

    @staticmethod
    def _hit(key: np.ndarray, which: np.ndarray, made: list[tuple], words: int, least) -> np.ndarray:
        """Does an occurrence (its key, its word) skip one of the merges made for its word?"""
        hit = np.zeros(len(key), bool)
        if not made:
            return hit
        rows, *spans = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(rows, kind="stable")
        spans = _span(*spans)[order]
        edge = np.searchsorted(rows[order], np.arange(words + 1))
        count = np.diff(edge)[which]
        for n in range(int(count.max())):
            live = np.flatnonzero((count > n) & ~hit)
            if not len(live):
                break
            hit[live] = A.mix(key[live] ^ spans[edge[which[live]] + n]) < least
        return hit

    def _bytes(self, flat, off, points, first):
        """The place holder 0xFFFF replaced by the bytes of its character: the characters without a piece, in order."""
        missing = points[self.char[points] < 0]
        encoded = [chr(p).encode("utf-8", "replace") for p in missing.tolist()]
        holes = np.flatnonzero(flat == 0xFFFF)
        length = np.ones(len(flat), np.int64)
        length[holes] = [len(e) for e in encoded]
        places = np.concatenate(([0], np.cumsum(length)))
        out = np.repeat(flat, length)
        if len(holes):
            spots = np.repeat(places[holes], length[holes]) + np.concatenate([np.arange(len(e)) for e in encoded])
            out[spots] = self.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, places[off]

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes one after another, without the mark in front."""
        out = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _span(start: np.ndarray, middle: np.ndarray, end: np.ndarray, into: np.ndarray) -> np.ndarray:
    """A hash of a candidate merge: its places in the word and the piece that it makes."""
    return A.mix(A.mix(start.astype(U64) << U64(42) | middle.astype(U64) << U64(21) | end.astype(U64)) + into.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def encode(docs: DataFrame, *, path: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """Of docs(doc_id, text): doc_id, ids (array<int>). A null doc_id counts as 0 in the keys."""
    path = path or model_path()

    def run(batches):
        model = pieces(path)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for ids, data, offsets in A.chunks(batches, 2, 1 << 20):
            ids = ids.cast(pa.int64())
            flat, at = model.encode(data, offsets, dropout, seed, _numbers(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))], schema=schema)

    return texts(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """Of encoded(doc_id, ids): doc_id, text."""
    path = path or model_path()

    def run(batches):
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x) if x is not None else None for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    texts(encoded, "doc_id")
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, path: str | None = None, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """Of docs(doc_id, text), encoded and decoded again in one pass: doc_id, n_pieces, ids_crc32 (unsigned 32-bit little-endian ids), lossless."""
    path = path or model_path()

    def run(batches):
        model = pieces(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])
        for ids, data, offsets in A.chunks(batches, 2, 1 << 20):
            ids = ids.cast(pa.int64())
            flat, at = model.encode(data, offsets, dropout, seed, _numbers(ids))
            raw, packed, edge, tokens = data.tobytes(), flat.astype("<u4").tobytes(), at.tolist(), flat.tolist()
            same = [model.decode(tokens[a:b]).encode() == raw[x:y] for a, b, x, y in zip(edge[:-1], edge[1:], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)], schema=schema)

    return texts(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
