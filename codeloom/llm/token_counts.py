"""Exact token counts at every prefix by dynamic programming.

A text is cut into pieces by the tokenizer's own splitting pattern; tokens never cross pieces.  Inside a piece, the
encoding of each prefix is the encoding of a shorter prefix plus one last token, so counts follow from left to right
(``Vocabulary.piece``).  A document's array holds by how much the count grows with each character, also where a cut
changes how the text is split (in white space, a contraction, a special string).  ``prefix_counts`` gives these arrays as
a column that can be stored; ``tokens_before``, ``longest_within`` and ``over_budget`` answer truncation and budget
questions from them, and nothing is encoded again.

Results for odd input: null and empty texts have no tokens and an empty array; the special string inside a text is one
token, as the tokenizers library treats it by default; very long texts and very long runs of one kind take time and memory
in proportion to their length; repeated rows each get a row; null ids stay null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._arrow import slices
from codeloom.llm._common import ship
from codeloom.llm.vocabulary import HELD, vocabulary

FIELDS = "doc_id long, n_bytes long, n_tokens long"
SLICE = 4 << 20


def tokens_before(steps: bytes, cut: int) -> int:
    """Tokens of the first ``cut`` characters."""
    return int(np.frombuffer(steps, "<i2", count=min(cut, len(steps) // 2)).sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """The most characters whose prefix has ``budget`` tokens at most."""
    counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int | None = None, stored: bool = True, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row; ``tokenizer`` is the path of a byte-level BPE .json file.

    With ``stored`` also steps, the prefix array (16-bit little-endian integers, one for each character).  With
    ``budget`` also cut, the characters of the longest prefix with so many tokens at most, and cut_all, whether that is
    the whole text.
    """
    more = (["cut long", "cut_all boolean"] if budget is not None else []) + (["steps binary"] if stored else [])
    fields = ", ".join([FIELDS, *more])
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer, held)
        for batch in batches:
            for part, _, at in slices(batch, "text", SLICE):
                arrays = [known.prefix_steps(t or "") for t in part.column("text").to_pylist()]
                columns = {"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_tokens": pa.array([int(a.sum(dtype=np.int64)) for a in arrays], pa.int64())}
                if budget is not None:
                    cuts = [longest_within(a, budget) for a in arrays]
                    columns |= {"cut": pa.array(cuts, pa.int64()), "cut_all": pa.array([c == len(a) for a, c in zip(arrays, cuts)], pa.bool_())}
                if stored:
                    columns["steps"] = pa.array([a.tobytes() for a in arrays], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    ship(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, fields)


def count_tokens(docs: DataFrame, tokenizer: str, budget: int = 512, **options) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (no prefix of ``budget`` tokens is the whole text), cut."""
    counts = prefix_counts(docs, tokenizer, budget, stored=False, **options)
    return counts.select("doc_id", "n_bytes", "n_tokens", (~F.col("cut_all")).alias("over_limit"), "cut")


def over_budget(stored: DataFrame, budget: int) -> DataFrame:
    """``stored`` prefix arrays with cut, the characters that ``budget`` tokens hold, and over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("steps")
            cuts = [longest_within(a.as_buffer(), budget) for a in arrays]
            over = [c < len(a.as_buffer()) // 2 for c, a in zip(cuts, arrays)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.int64()), pa.array(over, pa.bool_())], names=[*batch.schema.names, "cut", "over_limit"])

    ship(stored.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema), "cut long", "over_limit boolean"])
    return stored.mapInArrow(run, schema)
