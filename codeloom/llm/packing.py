"""Packing into sequences of equal length, balanced by estimated attention cost.

Each task tokenises the documents of its partition (ids of the tokenizers library, see ``vocabulary``) and packs them in
blocks of about ``block_tokens`` ids, so nothing is shuffled and a task holds one block.  Documents longer than a sequence
first give whole sequences.  For the rest of a block, as many sequences are opened as its ids fill.  Documents go in
descending order to the open sequence of lowest cost (linear + quadratic in each piece's length) that can hold them; one
that fits nowhere is cut to fill the cheapest.  What is left when all are full, some short documents, joins the next
block; the last block of a task packs its last few ids into sequences of powers of two, which need no padding.

Results for odd input: null and empty texts are the single end id; a very long text, of one kind of character too, is cut
into whole sequences; equal lengths go in the order of their rows; repeated rows are packed each; a null id stays null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codeloom.llm._arrow import slices
from codeloom.llm._common import ship
from codeloom.llm.vocabulary import HELD, vocabulary

FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SLICE = 4 << 20


def balance(lengths: list[int], rooms: list[int], linear: float = 1.0, quadratic: float = 1.0 / 2048) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack pieces into sequences of ``rooms`` ids: (piece, start in it, length, sequence, offset), and what of each piece is in none.

    All sequences are filled where the pieces have so many ids.
    """
    room, used, cost = np.array(rooms, np.int64), np.zeros(len(rooms), np.int64), np.zeros(len(rooms))
    out, rest = [], list(map(int, lengths))
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, rest[piece]
        while left:
            free = room - used
            fits = np.flatnonzero(free >= left)
            if not len(fits):
                fits = np.flatnonzero(free > 0)
                if not len(fits):
                    break
            k = int(fits[np.argmin(cost[fits])])
            n = min(left, int(free[k]))
            out.append((piece, start, n, k, int(used[k])))
            used[k] += n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
        rest[piece] = left
    return out, rest


class _Packer:
    """Documents (name, ids) of one task; ``packed`` gives rows of whole sequences."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.sequence = size, first
        self.names: list = []
        self.ids: list[np.ndarray] = []
        self.begin: list[int] = []  # ids of the document that earlier blocks have packed
        self.held = 0

    def add(self, name, ids: np.ndarray) -> None:
        self.names.append(name)
        self.ids.append(ids)
        self.begin.append(0)
        self.held += len(ids)

    def packed(self, last: bool) -> pa.RecordBatch:
        rows, size = [], self.size
        for d, x in enumerate(self.ids):
            while len(x) - self.begin[d] >= size:
                rows.append((d, self.begin[d], size, self.sequence, 0))
                self.begin[d] += size
                self.sequence += 1
        lengths = [len(x) - b for x, b in zip(self.ids, self.begin)]
        total = sum(lengths)
        rooms = [size] * (total // size)
        if last:
            rooms += [1 << k for k in range(size.bit_length() - 1, -1, -1) if total % size >> k & 1]
        placed, rest = balance(lengths, rooms, quadratic=1.0 / size)
        rows += [(d, self.begin[d] + s, n, self.sequence + k, offset) for d, s, n, k, offset in placed]
        self.sequence += len(rooms)
        columns = [[self.names[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [self.ids[d][s : s + n].tobytes() for d, s, n, _, _ in rows], [len(self.ids[r[0]]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], names=[f.split()[0] for f in FIELDS.split(", ")])
        left = [d for d, n in enumerate(rest) if n]
        self.begin = [len(self.ids[d]) - rest[d] for d in left]
        self.names, self.ids = [self.names[d] for d in left], [self.ids[d] for d in left]
        self.held = sum(rest)
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, block_tokens: int = 1 << 20, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers; ``tokenizer`` is the path of a .json file, ``held`` bounds a worker's table of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = vocabulary(tokenizer, held), np.array([end_id], "<u4")
        packer = _Packer(size, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE):
                for name, ids in zip(part.column("doc_id").to_pylist(), known.encode([t or "" for t in part.column("text").to_pylist()])):
                    packer.add(name, np.concatenate([ids, end]))
                    if packer.held >= block_tokens:
                        yield packer.packed(False)
        if packer.held:
            yield packer.packed(True)

    ship(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, FIELDS)
