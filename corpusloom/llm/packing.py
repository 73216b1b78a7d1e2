"""Packing by power-of-two decomposition.

The tokens of a document are cut into pieces whose lengths are the binary
digits of its own length, whole windows first. Each piece is a sequence of its
own, and sequences of one length lie together, so batches are full and no
sequence crosses documents or holds padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts
from .common import batch_bytes, number_rows, whole_text
from .tokens import pieces_of

MAX_TOKENS = 2048
END_TOKEN = 1

# Texts come to a worker, and pieces leave it, in batches of about so many bytes; texts are encoded so many at a time.
BATCH_BYTES = 8 << 20
PART_BYTES = 2 << 20


def binary_pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; ``most`` is a power of two."""
    out, start = [(k * most, most) for k in range(n // most)], n - n % most
    size = most >> 1
    while size:
        if n & size:
            out.append((start, size))
            start += size
        size >>= 1
    return out


@lru_cache(maxsize=1 << 14)
def _cuts(n: int, most: int) -> np.ndarray:
    return np.array(binary_pieces(n, most), np.int64).reshape(-1, 2)


PIECES_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def _decompose(name: str, most: int, end_token: int):
    names = [c.split()[0] for c in PIECES_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(name)
        for batch in batches:
            for part in parts(batch["_text"], PART_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, begins = pieces.ids(rows["_text"])
                ids = np.insert(ids, begins[1:], end_token).astype("<u4")
                tokens = np.diff(begins) + 1
                cuts = [_cuts(n, most) for n in tokens.tolist()]
                owner = np.repeat(np.arange(len(rows)), [len(c) for c in cuts])
                start, length = np.concatenate(cuts).T
                ends = np.concatenate([[0], np.cumsum(length)])  # pieces in order are all ids
                low = 0
                while low < len(owner):  # an Arrow array of bytes holds up to 2 GB
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] + BATCH_BYTES // 4, "right")) - 1)
                    data = ids[ends[low] : ends[high]]
                    offsets = (4 * (ends[low : high + 1] - ends[low])).astype(np.int32)
                    some = slice(low, high)
                    yield pa.record_batch(
                        [
                            rows["doc_id"].take(pa.array(owner[some])), pa.array(start[some]), pa.array(length[some]),
                            pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                            pa.array(tokens[owner[some]]),
                        ],
                        names,
                    )
                    low = high

    return run


def decompose(
    docs: DataFrame, name: str = "word_bpe_49k.json", most: int = MAX_TOKENS, end_token: int = END_TOKEN
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens`` for each piece; ``ids`` are little-endian 32-bit.

    Each text ends with ``end_token``, so a null or empty one is a single
    piece of length 1. Rows are taken one by one: repeated and null ids are
    packed like any others, other columns are not used, and an empty table has
    no pieces. No shuffle.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("_text"))
    return rows.mapInArrow(_decompose(name, most, end_token), PIECES_SCHEMA)


def bucket(pieces: DataFrame) -> DataFrame:
    """Pieces with ``sequence_id`` (long) and ``offset`` (always 0).

    Ids run through the lengths from long to short, mixed by a hash inside a
    length, so a batch of equal lengths is a range of ids.
    """
    mixed = F.xxhash64("doc_id", "start")
    order = [F.col("length").desc(), mixed, F.col("doc_id").asc_nulls_first(), F.col("start")]
    with batch_bytes(pieces.sparkSession, BATCH_BYTES):
        numbered = number_rows(pieces, order, "sequence_id")
    return numbered.withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, **how) -> DataFrame:
    """Sequences with their ids: :func:`decompose`, then :func:`bucket`."""
    return bucket(decompose(docs, **how))


def packing_digest(docs: DataFrame) -> DataFrame:
    """One row for each piece, with a checksum in place of its ids."""
    pieces = decompose(docs).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return bucket(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
