"""Packing tokenized documents into fixed windows by minimum bin slack.

Documents are cut at the window: full windows become sequences of their own, and what remains of each
document, shorter than a window, is packed with others. For each window the longest remainder is laid
down, then a bitset dynamic program over the multiset of remaining lengths finds the fill closest to the
capacity, and its kept rows are walked back to the counts taken of each length. Each task packs what it
reads in blocks, so nothing is shuffled and no task holds more than a block; what a block cannot fill
moves to the next. At a task's end the last remainders are cut to fill their windows, and the final
window, if not full, is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from keyloom.llm.common import kept, small_batches, texts, two

#: Remainders packed together, entries of the word cache, and the longest word kept in it.
BLOCK, CACHE_WORDS, CACHE_LENGTH = 1024, 400_000, 48
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def rank_table(path: str) -> dict[bytes, int]:
    """The pieces of a byte-level BPE in a tokenizer file, as bytes, with their ids.

    The file writes each byte as a printable character: those that print stand for themselves, the
    others are counted upwards from code point 256. Added (special) tokens are left out.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in made.get("added_tokens", ())}
    return {bytes(byte[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which are found in texts before anything else, with their ids."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f).get("added_tokens", ())
    for x in made:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
            raise ValueError(f"an added token with conditions: {x['content']}")
    return {x["content"]: x["id"] for x in made}


class WordCache(dict):
    """Packed ids of texts by a byte-level tokenizer whose pre-tokens start at single spaces; keys are words.

    As the tokenizer's library does unless told otherwise, the strings of added tokens in a text give those tokens; with
    ``ordinary`` they are text like any other.
    """

    def __init__(self, path: str, pattern: str, ordinary: bool = False):
        import tiktoken

        super().__init__()
        self.make = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})
        self.added = {} if ordinary else {k: v.to_bytes(4, "little") for k, v in added_tokens(path).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def pack(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.make.encode_ordinary(text)])

    def __missing__(self, word: str) -> bytes:
        ids = self.pack(" " + word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        from keyloom.llm.bpe import LOOSE

        if any(mark in text for mark in self.added):
            parts = self.marks.split(text)
            return b"".join([self.added[x] if i % 2 else self.pack(x) for i, x in enumerate(parts)])
        if LOOSE(text):
            return self.pack(text)
        start, *rest = text.split(" ")
        return self.pack(start) + b"".join(map(self.__getitem__, rest))


def tokenizer(path: str, pattern: str) -> WordCache:
    return kept(("packing", path, pattern), lambda: WordCache(path, pattern))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``capacity`` from below.

    Bit s of a row says that s can be reached with the lengths so far. A length that is there c times
    is tried in chunks of 1, 2, 4, ... up to c. Rows stop once the capacity itself is reached.
    """
    full, mask = 1 << capacity, (1 << capacity + 1) - 1
    rows, items, reach = [], [], 1
    for length in sorted(counts, reverse=True):
        left, chunk = counts[length], 1
        while left and length * chunk <= capacity and not reach & full:
            chunk = min(chunk, left)
            rows.append(reach)
            items.append((length, chunk))
            reach |= reach << length * chunk & mask
            left -= chunk
            chunk *= 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for before, (length, chunk) in zip(reversed(rows), reversed(items)):
        if not before >> total & 1:
            total -= length * chunk
            taken[length] = taken.get(length, 0) + chunk
    return taken


class Packer:
    """Pieces (document, start, length) of one task into sequences; ``emit`` gets each full sequence's pieces."""

    def __init__(self, window: int, emit: Callable[[list], None]):
        self.window, self.emit, self.waiting, self.n = window, emit, {}, 0

    def add(self, piece: tuple) -> None:
        """A piece is (length, document, start); one shorter than the window waits for its block."""
        if piece[0] == self.window:
            self.emit([piece])
            return
        self.waiting.setdefault(piece[0], []).append(piece)
        self.n += 1
        if self.n >= BLOCK:
            self.pack(False)

    def take(self, length: int) -> tuple:
        same = self.waiting[length]
        piece = same.pop()
        if not same:
            del self.waiting[length]
        self.n -= 1
        return piece

    def pack(self, last: bool) -> None:
        """Full windows from what waits; the rest waits on, or at the end is cut to fit."""
        while self.waiting:
            first = self.take(max(self.waiting))
            found = fill({k: len(v) for k, v in self.waiting.items()}, self.window - first[0])
            pieces = [first, *(self.take(k) for k, c in found.items() for _ in range(c))]
            if sum(p[0] for p in pieces) == self.window:
                self.emit(pieces)
                continue
            for p in pieces:
                self.waiting.setdefault(p[0], []).append(p)
                self.n += 1
            if not last:
                if self.n < BLOCK // 2:
                    return
                self.cut()  # a block that packs badly still ends
            else:
                while self.waiting:
                    self.cut()

    def cut(self) -> None:
        """One sequence from the longest pieces, the last of them cut: a window, or at the end powers of two."""
        total = sum(k * len(v) for k, v in self.waiting.items())
        size = self.window if total >= self.window else 1 << total.bit_length() - 1
        pieces, room = [], size
        while room:
            length, doc, start = self.take(max(self.waiting))
            if length > room:
                rest = (length - room, doc, start + room)
                self.waiting.setdefault(rest[0], []).append(rest)
                self.n += 1
                length = room
            pieces.append((length, doc, start))
            room -= length
        self.emit(pieces)


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most ``window`` tokens.

    ``encode()`` is called once in each worker and gives the function from a text to packed unsigned
    32-bit ids; ``end_id`` follows each document. A null text is the empty text and so a piece of one
    token; rows with equal or null keys are packed as documents of their own. Other columns are ignored.
    Columns: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset. Sequence ids differ
    between tasks; offsets in a sequence have no gaps.
    """
    if window & window - 1:
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, context = encode(), TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        out: list[tuple] = []
        made = 0
        tail = end_id.to_bytes(4, "little")

        def emit(pieces: list) -> None:
            nonlocal made
            offset = 0
            for length, (doc, first, ids, total), start in pieces:
                a = (start - first) * 4
                out.append((doc, start, length, ids[a : a + 4 * length], total, base + made, offset))
                offset += length
            made += 1

        def flush() -> pa.RecordBatch:
            schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return b

        packer = Packer(window, emit)
        for b in small_batches(batches):
            for doc, t in zip(b.column("doc_id").to_pylist(), texts(b)):
                ids = of(t) + tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[start * 4 : (start + window) * 4]
                    packer.add((len(part) // 4, (doc, start, part, n), start))
            if len(out) > 1000:
                yield flush()
        packer.pack(True)
        if out:
            yield flush()

    return two(docs, key, text).mapInArrow(run, SCHEMA)
