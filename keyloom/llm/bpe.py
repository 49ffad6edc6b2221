"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. Each merge rank owns a bucket of list positions, and a
two-level bitmap says which buckets hold something, so the lowest rank is found with two find-first-set
steps. Entries whose pair has changed since they were queued are skipped when they surface. A pre-token of
n bytes costs O(n log n) whatever its length, where the usual rescan is quadratic.

Pre-tokens repeat a lot, so encoded ones are kept in bounded caches that are emptied when full.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keyloom.llm.common import small_batches, texts, two

#: Entries kept in the cache of words and of other pre-tokens, and the longest (in characters) that is kept.
CACHE_WORDS, CACHE_OTHERS, CACHE_LENGTH = 1_400_000, 100_000, 48
#: White space as the rank files' library reads it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space that no pre-token starts at: such a text is split as a whole.
LOOSE = regex.compile(rf" (?:[{SPACE}]|\Z)").search
#: Marks that a word may end in: each is a pre-token of its own there.
MARKS = tuple(".,;:!?)")
_BITS = [1 << i for i in range(256)]


class ByteBPE(dict):
    """Encoder and decoder over a rank table: piece of bytes -> rank, which is also its id.

    As a dict it is the cache of words: letters only, the space before them understood.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.low = [0] * ((len(self.pieces) >> 8) + 1)  # which ranks of each 256 have a bucket; all zero between calls
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        """From a rank file: a base64 piece and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(data)
        if whole is not None:
            return [whole]
        low, bits, top, n = self.low, _BITS, 0, len(data)
        buckets: dict[int, list[int]] = {}
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))
        now: list[int | None] = [None] * n  # the rank under which the pair that starts here waits
        for i in range(n - 1):
            rank = rank_of(data[i : i + 2])
            if rank is not None:
                now[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= bits[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            rank = word << 8 | (low[word] & -low[word]).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[word] &= low[word] - 1
                if not low[word]:
                    top &= top - 1
            if now[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            now[j] = now[i] = None
            if stop < n:
                before[stop] = i
                new = rank_of(data[i : end[stop]])
                if new is not None:
                    now[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        low[new >> 8] |= bits[new & 255]
                        top |= 1 << (new >> 8)
            h = before[i]
            if h >= 0:
                new = now[h] = rank_of(data[h:stop])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        low[new >> 8] |= bits[new & 255]
                        top |= 1 << (new >> 8)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            stop = end[i]
            out.append(ranks[data[i:stop]])
            i = stop
        return out

    def piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token."""
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= CACHE_LENGTH:
                if len(self.known) >= CACHE_OTHERS:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        """Packed ids of a space and the text up to the next one: a word, a word and a mark, or more."""
        if chunk.isalpha():
            ids = np.array(self.merge(b" " + chunk.encode()), dtype="<u4").tobytes()
            if len(chunk) <= CACHE_LENGTH:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[chunk] = ids
            return ids
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.piece(chunk[-1])
        return b"".join(map(self.piece_or_word, self.split(" " + chunk)))

    def piece_or_word(self, piece: str) -> bytes:
        return self[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.piece(piece)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        Where every space is followed by something else than white space, a pre-token starts at each
        space, so the text is cut there and whole words are looked up.
        """
        if LOOSE(text):
            return b"".join(map(self.piece_or_word, self.split(text)))
        start, *rest = text.split(" ")
        return b"".join([*map(self.piece, self.split(start)), *map(self.__getitem__, rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """The encoder of a worker; each rank file is read once per worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every whole text.

    Null texts are empty texts and have no ids. Rows stay as many as they were, repeated and null keys
    included; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in small_batches(batches):
            ids = [bpe.encode(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return two(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of each row of :func:`encode`; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in small_batches(batches):
            out = [None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of each whole text and of what they decode to.

    :func:`encode` and :func:`decode` in one pass, without moving ids and bytes out of the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in small_batches(batches):
            ids = [bpe.encode(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([digest(x) for x in ids]), pa.array([digest(bpe.decode(x)) for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return two(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
