"""Vector best-fit packing of token pieces into sequences.

A bin has three residual capacities: tokens, documents and attention cost (the
sum of squared piece lengths).  Pieces are placed in decreasing size; each goes
into the feasible bin that a rule selects by its whole residual vector:

* ``norm``: the smallest weighted norm of what would be left, or
* ``dot``: the largest weighted dot product of residual and item.

A bin is feasible only if the piece fits under every capacity; if none is, a new
bin opens.  Ties go to the bin opened first.

Distribution: pieces are dealt by a hash of their identity into groups of about
``GROUP_PIECES``, identical ones of a task to one group after the other; every group is packed on its own in one task, holding numbers
only.  The number of groups follows the number of pieces, so a group never grows
with the corpus, and at most one bin a group is left poorly filled.

Defined results: a null text is an empty one and makes a piece of one token (id
0); a text that spells an added token of the vocabulary has its id; repeated rows are packed as rows of their own; null ids are packed too; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.fertility import BYTE_VOCABULARY, byte_ids
from roadflow.llm.shared import explode_texts
from roadflow.session import cut_lineage

MAX_TOKENS = 2048
END_ID = 0
#: As many documents as there can be tokens, and full attention over one piece:
#: these leave the number of sequences to the tokens unless set lower.
MAX_DOCS = 2048
MAX_COST = MAX_TOKENS ** 2
#: Weights of tokens, documents and cost in the selection rule.
WEIGHTS = (1.0, 0.05, 0.05)
GROUP_PIECES = 8192
#: Pieces that a task remembers to tell copies; beyond it only those seen twice.
DEALT_PIECES = 100_000


def cut(n: int, size: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: full pieces after a first one that may be shorter."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def token_pieces(docs: DataFrame, text: str, keep: list[str], max_tokens: int = MAX_TOKENS,
                 vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document: ``keep``, piece, start, length, ids (little-endian uint32)."""
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)

    def fn(texts):
        rows, made = [], ([], [], [], [])
        for row, text in enumerate(texts):
            ids = np.array([*byte_ids(path, text or ""), END_ID], "<u4")
            start = 0
            for piece, length in enumerate(cut(len(ids), max_tokens)):
                rows.append(row)
                for column, value in zip(made, (piece, start, length, ids[start:start + length].tobytes()),
                                         strict=True):
                    column.append(value)
                start += length
        return rows, list(made)

    return explode_texts(docs, text, fn, [("piece", "int"), ("start", "long"), ("length", "long"),
                                          ("ids", "binary")], keep)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, ...] = WEIGHTS,
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece; ``lengths`` come in the order of placement."""
    limit = np.array(capacity, np.float64)
    weight = np.array(weights, np.float64)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((max(n, 1), 3))  # residual capacities of open bins
    number = np.empty(max(n, 1), np.int64)
    n_open = opened = 0
    for i, length in enumerate(lengths.tolist()):
        item = np.array([length, 1, length * length], np.float64)
        if (item > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no bin of {capacity}")
        after = left[:n_open] - item
        fits = np.flatnonzero((after >= 0).all(1))
        if len(fits):
            if rule == "dot":
                score = -((left[fits] / limit) * (item / limit)) @ weight
            else:
                score = ((after[fits] / limit) ** 2) @ weight
            best = score.min()
            pick = fits[score == best]
            at = int(pick[number[pick].argmin()])
        else:
            at, n_open = n_open, n_open + 1
            left[at], number[at], opened = limit, opened, opened + 1
        bins[i], offsets[i] = number[at], capacity[0] - left[at, 0]
        left[at] -= item
        if (left[at] < 1).any():  # nothing more can go in: close it
            n_open -= 1
            left[at], number[at] = left[n_open], number[n_open]
    return bins, offsets


def dealt(pieces: DataFrame, order: list[str], groups: int) -> DataFrame:
    """Adds ``__group``: the hash of ``order``, plus the number of equal pieces before it in its partition.

    A piece without copies lies in the same group however the rows are partitioned.
    """
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            group = []
            for h in batch.column(len(names)).to_pylist():
                copies = seen.get(h, 0)
                seen[h] = copies + 1
                group.append((h + copies) % groups)
            if len(seen) > DEALT_PIECES:
                seen = {h: n for h, n in seen.items() if n > 1}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(group, pa.int64())], [*names, "__group"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("__group", T.LongType())])
    return pieces.withColumn("__group", F.xxhash64(*order)).mapInArrow(run, schema)


def pack(pieces: DataFrame, length: str = "length", order: list[str] | None = None,
         capacity: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCS, MAX_COST),
         weights: tuple[float, ...] = WEIGHTS, rule: str = "norm",
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``order`` names the columns that identify a piece: they deal it to a group
    and break ties of size, so a task that runs again places the same.  Carry
    numbers only; texts and ids stay in the table the pieces came from.
    """
    order = order or [c for c in pieces.columns if c != length]
    pieces = cut_lineage(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    names = pieces.columns

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([(length, "descending"), *((c, "ascending") for c in order)])
        bins, offsets = best_fit(frame[length].to_numpy(), capacity, weights, rule)
        sequence = (key[0].as_py() << 32) + bins
        return frame.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())) \
            .append_column("offset", pa.array(offsets, pa.int64()))

    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    return dealt(pieces, order, groups).groupBy("__group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Token ids are reduced to their checksum in the scan, so that packing moves a
    few numbers a piece; the ids themselves come from :func:`token_pieces`.
    """
    pieces = token_pieces(docs, text, [id_col]).select(
        id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, order=[id_col, "piece", "ids_crc32"], **options)
