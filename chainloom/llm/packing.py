"""Cost-balanced packing of documents into sequences of equal length."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructType

from chainloom.llm.common import small_batches, tidy
from chainloom.llm.tokens import text_blocks, word_ids

LENGTH = 4096
END = 2
#: Tokens gathered before a window is packed: it bounds a task's memory, and a window pads less than one sequence in 256.
WINDOW = 256 * LENGTH


def balance(sizes: list[int], length: int = LENGTH, linear: float = 1.0, quadratic: float = 1 / LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, size, sequence, offset) of every piece of items of given sizes.

    An item's cost is linear in its size for the layers, quadratic for attention. There are as few sequences as can hold all. Whole sequences are cut from long items first;
    then, from the largest on, each goes to the cheapest sequence with room for it, or, where none has, in pieces to the cheapest with any room."""
    out, rest, n = [], [], 0
    for i, size in enumerate(sizes):
        for start in range(0, size - length + 1, length):
            out.append((i, start, length, n, 0))
            n += 1
        if size % length:
            rest.append((size % length, i))
    rest.sort(key=lambda x: (-x[0], x[1]))
    k = -(-sum(size for size, _ in rest) // length)
    filled, cost = np.zeros(k, np.int64), np.zeros(k)
    for size, i in rest:
        start = sizes[i] - size
        while size:
            room = length - filled
            best = np.where(room >= size, cost, np.inf)
            j = int(best.argmin())
            if best[j] == np.inf:
                j = int(np.where(room > 0, cost, np.inf).argmin())
            piece = min(size, int(room[j]))
            out.append((i, start, piece, n + j, int(filled[j])))
            filled[j] += piece
            cost[j] += linear * piece + quadratic * piece * piece
            start, size = start + piece, size - piece
    return out


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, payload: str = "ids") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its `ids` (little-endian unsigned 32-bit), or with payload="crc32" their `ids_crc32`.

    Each task packs the rows it reads, window by window; nothing is shuffled. A sequence's id is its task's number and its number within, so a task run again gives the same.

    Cases: null or empty text: the end id alone. Repeated rows and null ids: packed like any other. A text longer than a window is packed whole in one. Empty table: no rows.
    Other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = StructType([docs.select(docs[doc_id].alias("doc_id")).schema[0]])
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())
    schema = schema.add(*(("ids", BinaryType()) if payload == "ids" else ("ids_crc32", LongType())))

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, number = word_ids(path), TaskContext.get().partitionId() << 33
        names, parts, held = [], [], 0

        def emit():
            nonlocal names, parts, held, number
            rows = balance([len(x) for x in parts], length)
            cut = [parts[i][s : s + n] for i, s, n, _, _ in rows]
            columns = [pa.array([names[r[0]] for r in rows], pa_id), *(pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: r[1], lambda r: r[2], lambda r: len(parts[r[0]]), lambda r: number + r[3], lambda r: r[4]))]
            columns.append(pa.array([x.tobytes() for x in cut], pa.binary()) if payload == "ids" else pa.array([zlib.crc32(x) for x in cut], pa.int64()))
            number += 1 + max(r[3] for r in rows)
            names, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            pa_id = batch.column(0).type
            for i, column in text_blocks(batch.column(1)):
                ids, offsets = words.column(column, end)
                for k, name in enumerate(batch.column(0).slice(i, len(column)).to_pylist()):
                    names.append(name)
                    parts.append(ids[offsets[k] : offsets[k + 1]])
                    held += len(parts[-1])
                    if held >= WINDOW:
                        yield emit()
        if parts:
            yield emit()

    return docs.select(docs[doc_id], docs[text]).mapInArrow(tidy(packed), schema)
