"""Sum-of-squares packing of tokenised documents into sequences.

Each task packs its own documents as they come. Full windows of a long document become sequences at once; its rest goes to the
fill level that keeps the sum of squared counts of partly filled windows smallest. A level is UNIT tokens wide. Windows become
sequences when they are full; one that has room for less than a level is filled up with the head of the next document, and so is
the fullest where another one would be opened beyond MOST_OPEN. Only those left at a task's end, MOST_OPEN windows and one at most,
are joined and cut into full windows; a task's last rest is cut into powers of two, which need no padding.

Defined cases: a null or empty text still has its end token; repeated rows are packed like any others; a null doc_id is carried
along. The packing depends on how the input is dealt to tasks, so a lost task gives the same rows when run again. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import TOKENIZER, StreamingBpe, packed, tokenizer_path
from basinflow.session import ship

LENGTH, END = 4096, 2
#: Tokens of a fill level, and open windows of a task.
UNIT, MOST_OPEN = 64, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence numbers of one task.
TASK_SEQUENCES = 1 << 36


class LibraryWords(StreamingBpe):
    """Token ids with the tokenizers library's merges for each word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model

    def tokens(self, word: bytes) -> bytes:
        letters = word.decode() if word.isalnum() else "".join(map(self.letters.__getitem__, word))
        return packed([t.id for t in self.model.tokenize(letters)])


@lru_cache(maxsize=2)
def load(path: str) -> LibraryWords:
    """One for each Python worker."""
    return LibraryWords(path)


class Packer:
    """pack() and finish() yield rows as in SCHEMA, doc_id being whatever stands for the document."""

    def __init__(self, first: int = 0, length: int = LENGTH, unit: int = UNIT, most_open: int = MOST_OPEN) -> None:
        self.length, self.unit, self.most_open, self.next = length, unit, most_open, first
        self.levels = [0] * (length // unit + 1)
        self.open: list[tuple[int, list[tuple]]] = []  # (tokens, pieces), the fullest first
        self.joined = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def best_window(self, size: int) -> int:
        """The open window, -1 for a new one, whose choice raises the sum of squares least; the fullest among equals."""
        levels, unit = self.levels, self.unit
        best, least = -1, 2 * levels[size // unit] + 1
        for k in range(len(self.open) - 1, -1, -1):
            filled = self.open[k][0]
            to = filled + size
            if to > self.length:
                break
            a, b = filled // unit, to // unit
            raised = 0 if a == b else 1 - 2 * levels[a] + (2 * levels[b] + 1 if self.length - to >= unit else 0)
            if raised <= least:
                best, least = k, raised
        return best

    def _take(self, k: int) -> tuple[int, list[tuple]]:
        filled, window = self.open.pop(k)
        self.levels[filled // self.unit] -= 1
        return filled, window

    def pack(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.length:
            yield from self._emit([(doc, start, ids[start : start + self.length], total)])
            start += self.length
        while start < total:
            size = total - start
            room = self.length - self.open[0][0] if self.open else self.length
            at = -1
            if room < self.unit and size > room:
                at = 0
            else:
                at = self.best_window(size)
                if at < 0 and len(self.open) >= self.most_open:
                    at = 0
            filled, window = self._take(at) if at >= 0 else (0, [])
            size = min(size, self.length - filled)
            window.append((doc, start, ids[start : start + size], total))
            start, filled = start + size, filled + size
            if filled == self.length:
                yield from self._emit(window)
                continue
            self.levels[filled // self.unit] += 1
            bisect.insort(self.open, (filled, window), key=lambda w: -w[0])

    def finish(self) -> Iterator[tuple]:
        """What is still open, joined and cut into full windows, the rest of it into powers of two."""
        pieces = [p for _, window in self.open for p in window]
        self.open, self.levels = [], [0] * len(self.levels)
        left = self.joined = sum(len(p[2]) for p in pieces)
        current: list[tuple] = []
        room = min(self.length, 1 << (left.bit_length() - 1)) if left else 0
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[:room]
                current.append((doc, start, part, total))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    yield from self._emit(current)
                    current, room = [], min(self.length, 1 << (left.bit_length() - 1)) if left else 0


def pack_documents(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents in sequences of LENGTH tokens; one pass, no shuffle."""
    ship(docs.sparkSession)
    columns = [part.split()[0] for part in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path(name))
        packer = Packer(TaskContext.get().partitionId() * TASK_SEQUENCES)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            values = zip(*found) if found else [[]] * len(columns)
            return pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in values], columns)

        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                found += packer.pack(doc.as_py(), np.append(bpe.encode(text.as_py()), np.uint32(END)))
            yield batch_of(found)
        yield batch_of(list(packer.finish()))
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def op5_packing(spark, sf_dir):
    from basinflow.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
