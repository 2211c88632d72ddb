"""Packing by best-fit decreasing.

Each task packs what it tokenises; nothing is shuffled. Pieces wait in a buffer of at most
BUFFER_TOKENS ids. When it is full they are placed in order of falling length, each into the
open window with the least sufficient room, which a segment tree over remaining capacities
finds in log2(window) steps. Windows that are nearly full leave; the others return to the
buffer. What is left at the end of a task is cut into sequences whose sizes are powers of
two, which need no padding.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidy

WINDOW = 4096
BUFFER_TOKENS = 4 << 20
#: Windows filled to this share leave the buffer.
FULL = 0.99
#: Bytes of the younger half of a worker's cache; when it is full it becomes the older half. An entry's overhead.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 180
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks(dict):
    """ids (little-endian unsigned 32-bit bytes) of a chunk of text without ASCII white space.

    The tokenizer lower-cases and splits at white space first, so a text's ids are those of
    its chunks in order, and ASCII case may go before (but for texts with special tokens).
    Trailing punctuation after an ASCII letter or digit is split off here too, since it cannot
    join or change the tokens before it. A chunk of letters that normalising leaves as they are is
    one word to the tokenizer, so it goes to its merges directly.
    """

    TAIL = b'.,;:!?$%&*#"()-'

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    @classmethod
    def of_worker(cls, path: str) -> Chunks:
        """One cache for all tasks that a Python worker runs."""
        import sys

        held = sys.__dict__.setdefault("_emberplan_chunks", {})
        if path not in held:
            held.clear()
            held[path] = cls(path)
        return held[path]

    def age(self) -> None:
        if self.held > CACHE_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0

    def encode(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        plain = text.isalpha() and text.lower() == text and (text.isascii() or unicodedata.is_normalized("NFC", text))
        return array("I", (self.words if plain else self.tokenizer).encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if (out := self.older.get(chunk)) is None:
            body = chunk.rstrip(self.TAIL)
            out = self[body] + self[chunk[len(body) :]] if body != chunk and body[-1:].isalnum() else self.encode(chunk)
        self[chunk] = out
        self.held += ENTRY_BYTES + len(chunk) + len(out)
        return out


class Room:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, which: int) -> None:
        self.open.setdefault(room, []).append(which)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room >= need: (room, window)."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.count[2 * at])
        room = at - self.size
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of lengths (each 1..window) by window."""
    room, out = Room(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.tightest(lengths[i])
        if found is None:
            left, which = window, len(out)
            out.append([])
        else:
            left, which = found
        out[which].append(i)
        if left > lengths[i]:
            room.put(left - lengths[i], which)
    return out


class Packer:
    """Takes (doc, ids) and yields rows of SCHEMA as column lists."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.wait: list[tuple] = []  # (doc, start, tokens of the document, ids)
        self.tokens = 0

    def add(self, doc, ids: bytes):
        n, w = len(ids) // 4, self.window
        for at in range(0, n, w):
            part = ids[4 * at : 4 * (at + w)]
            if len(part) == 4 * w:
                yield self._rows([(doc, at, n, part)])
            else:
                self.wait.append((doc, at, n, part))
                self.tokens += len(part) // 4

    def pack(self, last: bool):
        pieces, self.wait, self.tokens = self.wait, [], 0
        for which in best_fit_decreasing([len(p[3]) // 4 for p in pieces], self.window):
            inside = [pieces[i] for i in which]
            filled = sum(len(p[3]) // 4 for p in inside)
            if filled >= FULL * self.window or filled & (filled - 1) == 0 and last:
                yield self._rows(inside)
            elif last:
                yield from self._by_powers(inside, filled)
            else:
                self.wait += inside
                self.tokens += filled

    def _by_powers(self, inside: list[tuple], filled: int):
        inside = inside[::-1]
        for bit in range(filled.bit_length() - 1, -1, -1):
            need, seq = filled & (1 << bit), []
            while need:
                doc, start, n, ids = inside.pop()
                k = min(need, len(ids) // 4)
                seq.append((doc, start, n, ids[: 4 * k]))
                need -= k
                if 4 * k < len(ids):
                    inside.append((doc, start + k, n, ids[4 * k :]))
            if seq:
                yield self._rows(seq)

    def _rows(self, inside: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc, start, n, ids in inside:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return rows


def pack_batches(batches, path: str, window: int, end_id: int, partition: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names])
    chunks, packer, rows = Chunks.of_worker(path), Packer(window, partition << 32), []
    end = np.array([end_id], "<u4").tobytes()

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            chunks.age()
            for r in packer.add(doc, b"".join(map(chunks.__getitem__, (raw if b"<|" in raw else raw.lower()).split())) + end):
                rows += r
            if packer.tokens >= BUFFER_TOKENS:
                for r in packer.pack(last=False):
                    rows += r
                if packer.tokens >= BUFFER_TOKENS // 2:  # pieces that fit with nothing here
                    for r in packer.pack(last=True):
                        rows += r
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
    for r in packer.pack(last=True):
        rows += r
    if rows:
        yield batch(rows)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = 2
) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` tokens.

    Null texts are empty: a document then has only its end id. Repeated rows are documents of
    their own. A text of any length is cut into full windows first; one without any white space goes
    to the tokenizer whole. Documents without an id keep a null id. An empty table gives no
    rows. Only the two named columns are read, so others may bear any name. Sequence ids
    are those of the task's partition in the upper, a counter in the lower 32 bits: a lost
    task repeats with the same ids.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches):
        from pyspark import TaskContext

        yield from pack_batches(batches, path, window, end_id, TaskContext.get().partitionId())

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tidy(run), SCHEMA)
