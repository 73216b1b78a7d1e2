"""Exact deduplication by Grace hashing.

Records (one content each, with what is known of its rows) are dealt out to
buckets by a hash of the content. A bucket goes through an open-addressing
table that compares complete contents and may hold so many bytes. Contents
that find no room are written out again, and dealt out by another hash into
buckets of their own; this is repeated until every content was in a table.

Before the first deal each task runs its own rows through such a table, so a
content that a third of all rows have leaves a task once for each filling of
the table, not once a row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

from .batches import parts
from .common import SPACES, batch_bytes, join_facts, whole_text
from .needed import among

# Bytes of different contents that a table holds, and that a bucket should have.
TABLE_BYTES = 24 << 20
BUCKET_BYTES = 16 << 20
# Rows pass between Spark and a worker in batches of about so many bytes, and become Python objects so many at a time.
BATCH_BYTES = 8 << 20
PART_BYTES = 2 << 20
# At most so many partitions are dealt at once. More buckets share a partition, which Spark sorts by bucket.
FAN_OUT = 4_000

RECORD = "h long, content binary, n long, best_length long, best_id long, n_best long, digest binary"


class ContentTable:
    """Linear probing over a power of two of slots, at most half full.

    A slot holds the number of an entry. Entries meet if their hashes and then
    their complete contents are equal.
    """

    def __init__(self, most_bytes: int) -> None:
        self.slots, self.room = array("q", [-1]) * 64, most_bytes
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.facts: list[list] = []  # n, best_length, best_id, n_best

    def _slot(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if content is not None and self.hashes[k] == h and self.contents[k] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, facts: list) -> bool:
        """False if the content is new and there is no room for it."""
        at = self._slot(h, content)
        k = self.slots[at]
        if k >= 0:
            merge(self.facts[k], facts)
            return True
        if self.contents and self.room < len(content):
            return False
        self.room -= len(content) + 64
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.facts.append(facts)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for k, h in enumerate(self.hashes):
                self.slots[self._slot(h, None)] = k
        return True


def merge(into: list, other: list) -> None:
    """Add the rows of ``other``; the longest text, then the smallest id, is best, null ids last."""
    into[0] += other[0]
    mine = (-into[1], into[2] is None, into[2] or 0)
    theirs = (-other[1], other[2] is None, other[2] or 0)
    if theirs < mine:
        into[1:] = other[1:]
    elif theirs == mine:
        into[3] += other[3]


def _through_table(most_bytes: int, finish: bool):
    """Run a partition through a table, or through one after the other if its rows come by ``bucket``.

    Entries come out as records again, and a full table makes way for an empty
    one; or if ``finish`` as classes, with a digest in place of the content, and
    what found no room comes out as it went in.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1] or b"") + 100
            if size > PART_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def entries(table: ContentTable) -> Iterator[tuple]:
        for h, content, facts in zip(table.hashes, table.contents, table.facts):
            if finish:
                yield (h, None, *facts, hashlib.sha256(content).digest())
            else:
                yield (h, content, *facts, None)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table, at = ContentTable(most_bytes), None
        for batch in batches:
            for some in parts(batch["content"], PART_BYTES):
                rows = batch.slice(some.start, some.stop - some.start)
                columns = [rows[n].to_pylist() for n in names[:-1]]
                buckets = rows["bucket"].to_pylist() if "bucket" in rows.schema.names else repeat(None)
                for bucket, h, content, *facts in zip(buckets, *columns):
                    if bucket != at:
                        yield from entries(table)
                        table, at = ContentTable(most_bytes), bucket
                    if table.add(h, content, facts):
                        continue
                    if finish:
                        yield (h, content, *facts, None)
                    else:
                        yield from entries(table)
                        table = ContentTable(most_bytes)
                        table.add(h, content, facts)
        yield from entries(table)

    return lambda batches: in_batches(rows_of(batches))


def content_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_bytes: int = TABLE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row for each different content: ``digest, n, best_length, best_id, n_best``.

    ``best_*`` name the row with the longest original text, then the smallest
    id; ``n_best`` rows have both. Buckets have about ``bucket_bytes``; up to
    ``fan_out`` of them are partitions of their own, more are dealt to that
    many partitions and sorted in each, so that one after the other passes
    through a table.
    """
    text = whole_text(F.col(text_column))
    content = F.translate(text, SPACES, "")
    one = F.lit(1).cast("long")
    records = docs.select(
        F.xxhash64(content).alias("h"), content.cast("binary").alias("content"), one.alias("n"),
        F.length(text).cast("long").alias("best_length"), F.col(id_column).cast("long").alias("best_id"),
        one.alias("n_best"), F.lit(None).cast("binary").alias("digest"),
    )
    todo = records.mapInArrow(_through_table(table_bytes, finish=False), RECORD)
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    classes, level = None, 0
    while True:
        buckets = max(1, -(-size // bucket_bytes))
        dealt = _dealt(todo, buckets, fan_out, level)
        with batch_bytes(docs.sparkSession, BATCH_BYTES):
            spill = cut_lineage(dealt.mapInArrow(_through_table(table_bytes, finish=True), RECORD))
        done = spill.where("digest IS NOT NULL").drop("h", "content")
        classes = done if classes is None else classes.unionByName(done)
        todo = spill.where("digest IS NULL")
        size = todo.agg(F.sum(F.octet_length("content") + 64)).first()[0]
        if size is None:
            return classes
        level += 1


def _dealt(records: DataFrame, buckets: int, fan_out: int, level: int) -> DataFrame:
    """Records in partitions that hold one bucket, or several by ``bucket``; each level deals by another hash."""
    if buckets <= fan_out:
        return records.repartition(buckets, F.xxhash64("h", F.lit(level)))
    bucket = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(buckets))
    return records.withColumn("bucket", bucket).repartitionById(fan_out, (F.col("bucket") % fan_out).cast("int")).sortWithinPartitions("bucket")


def exact_copies(docs: DataFrame, carry: bool = False, **how) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal if they are identical without white space (null counts as
    empty, so null, empty and blank texts are one group). Of a group the row
    with the longest text stays, then the one with the smallest id; null ids
    come last. Of rows that are the same in both, any one stays. An empty
    table stays empty. With ``carry`` there is also ``_row``, the row as it
    was, whatever its columns are called. A very long text is one record, which
    a table takes alone if it must. Only rows of groups meet their facts by a
    join; a filter of bounded size tells most others, which stay where they are.
    """
    classes = cut_lineage(content_classes(docs, **how).where("n > 1"))
    totals = classes.agg(F.sum("n").alias("rows"), F.max("n_best").alias("repeated")).first()
    text = whole_text(F.col("text"))
    rows = docs.select(
        *([F.struct("*").alias("_row")] if carry else []),
        F.col("doc_id"),
        F.length(text).cast("long").alias("_length"),
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
    )
    some, alone = among(rows, classes, "digest")
    found = join_facts(some, classes, "digest", "n", totals["rows"] or 0)
    best = F.col("n").isNull() | (
        (F.col("_length") == F.col("best_length")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    )
    found = found.withColumn("kept", best)
    if (totals["repeated"] or 1) > 1:  # some rows are there twice
        tied = F.col("kept") & (F.coalesce("n_best", F.lit(1)) > 1)
        apart = F.concat(F.col("digest"), F.monotonically_increasing_id().cast("string").cast("binary"))
        found = found.withColumn("_tie", F.when(tied, F.col("digest")).otherwise(apart))
        place = F.row_number().over(Window.partitionBy("_tie", "kept").orderBy("_length"))
        found = found.withColumn("kept", F.col("kept") & (place == 1)).drop("_tie")
    none = {f.name: F.lit(None).cast(f.dataType) for f in classes.schema if f.name != "digest"}
    found = found.unionByName(alone.withColumns(none | {"kept": F.lit(True)}))
    return found.select(
        *(["_row"] if carry else []),
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with their columns."""
    return exact_copies(docs, carry=True, **how).where("kept").select("_row.*")


_PLAIN = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
EXACT_SQL = f"""
WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_PLAIN} AS content FROM documents),
ranked AS (
  SELECT doc_id, content,
    first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY content) AS group_size,
    row_number() OVER (PARTITION BY content ORDER BY n DESC, doc_id) = 1 AS kept
  FROM plain)
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM ranked"""
