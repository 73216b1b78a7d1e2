"""Periodic runs of words by online dyadic square catching.

The words of a text are appended one after the other. For each power of two
``h``, every completed block of ``h`` words gets a catcher that waits for its
block to be repeated 2h - 1 to 4h - 2 words later: the left half of a square
whose period lies there contains such a block. A repetition sets off suffix
comparisons, which widen the stretch of words that equal the word one period
later; a stretch as long as its period is a square, and overlapping squares of
a period are one run. Catchers of one size are compared with all words that
come after their blocks at once, as arrays, in place of one word at a time.

Equality of blocks is judged by hashes, of which only false matches could be
feared; every reported run is compared word by word, and cut where its words
differ. Catchers inside a run with at most half their size as its period do
not listen inside that run, where they would only hear its multiples, so a
text that repeats one word a million times takes no longer than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mix, parts, split_words
from .common import let, whole_text
from .common import split_words as words_of

# Runs of fewer words are no runs.
LEAST = 12
# Catchers are compared with so many places at a time.
CELLS = 1 << 21

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

RUNS_SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Blocks:
    """Comparison of any two stretches of equal length by running sums."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        with np.errstate(over="ignore"):
            self.power = np.full(n + 1, BASE, np.uint64)
            self.power[0] = 1
            np.cumprod(self.power, dtype=np.uint64, out=self.power)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def equal(self, i: np.ndarray, apart: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from ``i`` on equal those ``apart`` words later; false where these end too late."""
        n = len(self.sums) - 1
        fits = (i >= 0) & (i + apart + size <= n)
        i = np.where(fits, i, 0)
        j = np.where(fits, i + apart, 0)
        size = min(size, n)
        with np.errstate(over="ignore"):
            here = (self.sums[i + size] - self.sums[i]) * self.power[j - i]
            there = self.sums[j + size] - self.sums[j]
        return fits & (here == there)

    def of(self, size: int) -> np.ndarray:
        """A hash of every stretch of ``size`` words."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            back = np.full(n, INVERSE, np.uint64)
            back[0] = 1
            np.cumprod(back, dtype=np.uint64, out=back)
            return (self.sums[size:] - self.sums[:-size]) * back


def _caught(hashes: np.ndarray, h: int, deaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, first and last block of each series of neighbouring blocks that are repeated one period later.

    Block ``k`` begins at ``k * h`` and does not listen to periods up to ``deaf[k]``.
    """
    periods = np.arange(2 * h - 1, 4 * h - 1)
    n, blocks = len(hashes), len(deaf)
    padded = np.concatenate([hashes, np.zeros(4 * h, np.uint64)])
    wide = np.lib.stride_tricks.sliding_window_view(padded[2 * h - 1 :], 2 * h)[::h]
    own = hashes[::h]
    step = max(1, CELLS // (2 * h))
    firsts, lasts = [], []
    for start in range(0, blocks, step):
        low, high = max(start - 1, 0), min(start + step + 1, blocks)
        match = (wide[low:high] == own[low:high, None]) & (periods > deaf[low:high, None])
        if (high - 1) * h + 4 * h - 2 >= n:
            match &= np.arange(low, high)[:, None] * h + periods < n
        if low == start:
            match = np.concatenate([np.zeros((1, 2 * h), bool), match])
        if high < start + step + 1:
            match = np.concatenate([match, np.zeros((1, 2 * h), bool)])
        for edge, out in ((match[1:-1] & ~match[:-2], firsts), (match[1:-1] & ~match[2:], lasts)):
            k, p = np.nonzero(edge)
            out.append(np.stack([p, k + start]))
    first, last = (np.concatenate(x, axis=1) for x in (firsts, lasts))
    first, last = (x[:, np.lexsort((x[1], x[0]))] for x in (first, last))
    return periods[first[0]], first[1], last[1]


def find_runs(x: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least ``least`` numbers, by start, then period.

    ``x`` may hold several texts one after the other if no number occurs in
    two of them; ``longest`` is the length of the longest.
    """
    none = np.zeros(0, np.int64)
    found = (none, none, none)
    if longest < 2:
        return found
    blocks, h = _Blocks(x), 1
    while 4 * h - 2 <= longest:
        deaf = np.full(len(x) // h, -1)
        start, end, period = found
        inside = (2 * period <= h) & (end - start >= 3 * h - 1)
        if inside.any():
            first, past = -(-start[inside] // h), end[inside] // h
            count = np.maximum(past - first, 0)
            k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            deaf[k] = np.repeat(end[inside], count) - (k + 1) * h
        q, first, last = _caught(blocks.of(h), h, deaf)
        low, high = first * h, (last + 1) * h
        size = h >> 1
        while size:  # neither neighbouring block is repeated as a whole, so the rest is less than a block
            low = low - size * blocks.equal(low - size, q, size)
            high = high + size * blocks.equal(high, q, size)
            size >>= 1
        square = (high - low >= q) & (high - low + q >= least)
        new = [_checked(x, *r) for r in zip(low[square].tolist(), high[square].tolist(), q[square].tolist())]
        new = [(a, b + p, p) for a, b, p in (r for rs in new for r in rs) if b - a + p >= least]
        if new:
            found = _smallest(*(np.concatenate(c) for c in zip(found, np.array(new).T)))
        h *= 2
    return found


def _checked(x: np.ndarray, low: int, high: int, q: int) -> list[tuple[int, int, int]]:
    """The parts of the stretch that really equal the words ``q`` later and are long enough for a square."""
    same = x[low:high] == x[low + q : high + q]
    if same.all():
        return [(low, high, q)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(low + a, low + b, q) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()) if b - a >= q]


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run for each stretch of words; a run of a multiple of the period covers the same words."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch["_text"]):
                rows = batch.slice(part.start, part.stop - part.start)
                codes, begins, words = split_words(rows["_text"])
                owner = np.repeat(np.arange(len(rows)), np.diff(begins))
                start, end, period = find_runs(codes + owner * len(words), int(np.diff(begins).max()), least)
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                kept = np.cumsum(change[:-1]) == 0
                places = np.concatenate([[0], np.cumsum(kept)])[begins]
                values = words.take(pa.array(codes[kept]))
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(places), values), pa.scalar(" ", pa.large_string()))
                of = np.searchsorted(begins, start, "right") - 1
                # a text without words begins where the next one does; the last of them has the run's words
                listed = pa.StructArray.from_arrays(
                    [pa.array(start - begins[of]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]
                )
                counts = np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.record_batch(
                    [rows["doc_id"], pa.ListArray.from_arrays(pa.array(counts), listed), texts.cast(pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row.

    A run is a stretch of words with a smallest period of at most half its
    length that cannot be extended with that period; those of at least
    ``least`` words are listed as ``start, length, period`` in words, by start,
    then period. ``collapsed`` is the text's words joined by one space without
    those that any run holds after its first period. Null, empty and blank
    texts have no runs and collapse to the empty text. Rows are taken one by
    one: repeated and null ids are handled like others, no other column is
    used, and an empty table gives none. A very long text is handled whole, in
    arrays of about fifty bytes for each of its words. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("_text"))
    return rows.mapInArrow(_runs(least), RUNS_SCHEMA)


# --- the query ---


def plant_periods(doc_id: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, by a hash of the id, the words from some place on recur.

    Nulls as texts or ids leave the text as it is.
    """
    number = F.crc32(doc_id.cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        g, n = F.floor(number / 10), F.size(words)

        def at(a: Column) -> Column:
            p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
            times = F.ceil((n - a) / p).cast("int")
            rest = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p.cast("int")), times)), F.lit(1), n - a)
            return F.array_join(F.concat(F.slice(words, F.lit(1), a), rest), " ")

        return F.when(n > 0, let((g % n).cast("int"), at)).otherwise(F.lit(""))

    return F.when((number % 10 == 0) & text.isNotNull(), let(words_of(text), planted)).otherwise(text)


def runs_digest(docs: DataFrame) -> DataFrame:
    """One row for each document, with checksums in place of its runs and its collapsed text."""
    planted = docs.select("doc_id", plant_periods(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    longest = F.get(
        F.array_sort(F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"]))), F.lit(0)
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        periodic_runs(planted)
        .withColumn("_longest", longest)
        .select(
            "doc_id",
            F.size(runs).cast("long").alias("n_runs"),
            F.col("_longest.start").alias("start"),
            F.col("_longest.length").alias("length"),
            F.col("_longest.period").alias("period"),
            F.expr("_longest.length * 1000 div _longest.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
