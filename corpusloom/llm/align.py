"""Tokens of two tokenizers aligned by where they end.

Both token sequences spell the same bytes, so the ends of their tokens are two
sorted lists. The shorter list drives a galloping search in the longer one:
steps double until they pass the wanted end, and a binary search finishes
inside the last step. Ends in both lists cut the sequences into groups; the
differences of their ranks are the ranges of tokens that overlap.

An ordinary text is cut at white space, where both tokenizers provably cut
too, and each different piece of a batch is encoded and aligned once; a text's
alignment is that of its pieces, one after the other. Other texts are one
piece. All pieces of a batch are searched together, as arrays.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

from .batches import gather, parts, split_pieces, texts_with
from .common import SPACES, join_facts, whole_text
from .tokens import ODD, ODD_FIRST, first_bytes, public_path

# An id pair in one number: the first tokenizer's id, then so many bits of the second one's.
PAIR_BITS = 20

# Counts of up to so many id pairs (of 40 bytes in memory) are sent to every task; more are joined by a shuffle.
SENT_PAIRS = 1_000_000

# Texts are handled together up to so many bytes.
PART_BYTES = 5 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def common_ends(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the numbers in both; each list ascends strictly.

    ``start`` says for each number of ``short`` where in ``long`` to begin;
    nothing before that place is as large.
    """
    low, n = start.astype(np.int64), len(long)
    padded = np.append(long, np.iinfo(np.int64).max)
    high, step = low.copy(), 1
    going = np.flatnonzero(padded[high] < short)
    while len(going):  # gallop
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, n)
        step *= 2
        going = going[padded[high[going]] < short[going]]
    going = np.flatnonzero(low < high)
    while len(going):  # search inside the last step
        middle = (low[going] + high[going]) >> 1
        less = padded[middle] < short[going]
        low[going] = np.where(less, middle + 1, low[going])
        high[going] = np.where(less, high[going], middle)
        going = going[low[going] < high[going]]
    met = np.flatnonzero(padded[low] == short)
    return met, low[met]


@dataclass(frozen=True)
class Units:
    """Alignments of several texts: ``symbols`` and ``pairs`` are flat, and ``*_at`` says where each text's begin."""

    n_a: np.ndarray
    n_b: np.ndarray
    symbols: np.ndarray
    symbols_at: np.ndarray
    pairs: np.ndarray
    pairs_at: np.ndarray
    wrong: np.ndarray


def _ranges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class Aligned:
    """Aligns texts of a byte-level BPE of ``tokenizers`` with those of a BPE of ``sentencepiece``.

    A symbol is a token's id as it stands in the groups: with the comma, bar or
    semicolon behind it.
    """

    def __init__(self, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(public_path(first))
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_path(second))
        # byte-level spelling: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
        letter = {chr(c): c for c in shown} | {
            chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(shown))
        }
        vocabulary = self.first.get_vocab(False)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for shown_as, i in vocabulary.items():
            spelled[i] = bytes(letter[c] for c in shown_as)
        n = self.second.get_piece_size()
        pieces = [self.second.id_to_piece(i) for i in range(n)]
        pieced = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (spelled, pieced))
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (spelled, pieced))
        self.shift = len(spelled)
        self.shown = pa.array(
            [f"{i}{end}" for ids, ends in ((spelled, ",|"), (pieced, ",;")) for end in ends for i in range(len(ids))],
            pa.large_string(),
        )
        self.lone = self.second.piece_to_id("▁")
        # No token of the second reaches over a cut: a word mark only begins tokens, and white space is in none.
        joined = [p for i, p in enumerate(pieces) if not self.second.is_byte(i) and not self.second.is_control(i)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in joined)
        inside = {c for p in joined for c in p}
        self.cuts = np.zeros(256, bool)
        self.cuts[[ord(c) for c in SPACES if c not in inside]] = True
        self.odd = ODD[:-1] + "▁" + "".join(c for c in SPACES if c in inside) + "]"
        self.odd_bytes = first_bytes(ODD_FIRST + self.odd[len(ODD) - 1 : -1])

    def _encode(self, texts: list[str]) -> tuple[list, list[list[int]]]:
        a = self.first.encode_batch_fast(texts, add_special_tokens=False)
        b = self.second.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        for k, text in enumerate(texts):
            if text[:1] != " ":  # the added space is a token of its own, as the text begins with white space
                b[k] = b[k][1:] if b[k] and b[k][0] == self.lone else [0]
            elif text == " ":  # nothing is added to an empty text
                b[k] = [self.lone]
        return [e.ids for e in a], b

    def align(self, texts: list[str]) -> Units:
        """Alignments of texts that begin with the space which the second tokenizer adds, or with other white space.

        Texts that a sequence does not spell are ``wrong`` and have no tokens.
        """
        lists_a, lists_b = self._encode(texts)
        wanted = pa.array([t.encode() for t in texts], pa.large_binary())
        wrong = np.zeros(len(texts), bool)
        for lists, table in ((lists_a, self.bytes_a), (lists_b, self.bytes_b)):
            sizes = np.array([len(x) for x in lists])
            got = pa.LargeListArray.from_arrays(pa.array(_ranges(sizes)), table.take(pa.array(chain.from_iterable(lists), pa.int64())))
            wrong |= ~pc.equal(pc.binary_join(got, pa.scalar(b"", pa.large_binary())), wanted).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(wrong).tolist():
            lists_a[k], lists_b[k] = [], []
        n_a, n_b = (np.array([len(x) for x in lists], np.int64) for lists in (lists_a, lists_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((lists_a, n_a), (lists_b, n_b)))
        in_a, in_b = self._common(a, b, n_a, n_b)
        # each group: its tokens of the one, the last with a bar, then its tokens of the other, the last with a semicolon
        group_a = np.searchsorted(in_a, np.arange(len(a)))
        group_b = np.searchsorted(in_b, np.arange(len(b)))
        show_a, show_b = a.copy(), b + 2 * self.shift
        show_a[in_a] += self.shift
        show_b[in_b] += len(self.size_b)
        before_b, before_a = np.concatenate([[0], in_b + 1]), np.append(in_a, len(a) - 1) + 1
        symbols = np.empty(len(a) + len(b), np.int32)
        symbols[np.arange(len(a)) + before_b[group_a]] = show_a
        symbols[np.arange(len(b)) + before_a[group_b]] = show_b
        owner = np.repeat(np.arange(len(texts)), n_a)[in_a]
        pairs = a[in_a] << PAIR_BITS | b[in_b]
        return Units(n_a, n_b, symbols, _ranges(n_a + n_b), pairs, np.searchsorted(owner, np.arange(len(texts) + 1)), wrong)

    def _common(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens whose ends are common; texts follow each other, so a text's ends lie behind the last one's."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if len(a) <= len(b):
            return common_ends(ends_a, ends_b, np.repeat(_ranges(n_b)[:-1], n_a))
        in_b, in_a = common_ends(ends_b, ends_a, np.repeat(_ranges(n_a)[:-1], n_b))
        return in_a, in_b


@lru_cache(maxsize=2)
def aligning(first: str, second: str) -> Aligned:
    return Aligned(first, second)


def _align_rows(aligned: Aligned, texts: pa.Array) -> Iterator:
    """For texts with their leading space: numbers of tokens and groups, all pairs, whose they are, and groups as bytes."""
    whole = texts_with(texts, aligned.odd, aligned.odd_bytes) if aligned.cuttable else np.ones(len(texts), bool)
    cut = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
    codes, begins, different = split_pieces(cut, aligned.cuts)
    odd = np.flatnonzero(whole)
    units = aligned.align(different.to_pylist() + texts.take(pa.array(odd)).to_pylist())
    # an odd text is one piece, which stands where the text is
    codes = np.insert(codes, begins[odd], len(different) + np.arange(len(odd)))
    begins = begins + np.concatenate([[0], np.cumsum(whole)])
    bad = _ranges(units.wrong[codes])[begins]
    bad = bad[1:] > bad[:-1]
    keep = ~np.repeat(bad, np.diff(begins))
    codes = codes[keep]
    begins = _ranges(keep)[begins]
    picked, at = gather(codes, units.pairs_at)
    pairs_at = at[begins]
    n_a, n_b = (np.diff(_ranges(x[codes])[begins]) for x in (units.n_a, units.n_b))
    numbers = np.stack([n_a, n_b, np.diff(pairs_at)])
    owner = np.repeat(np.arange(len(texts)), numbers[2])
    pairs = units.pairs[picked]
    picked, at = gather(codes, units.symbols_at)
    shown = aligned.shown.take(pa.array(units.symbols[picked]))
    edges = np.frombuffer(shown.buffers()[1], np.int64)[: len(shown) + 1][at[begins]].tolist()
    text = memoryview(shown.buffers()[2] or b"")
    groups = [text[i : max(i, j - 1)] for i, j in zip(edges, edges[1:])]  # without the last semicolon
    return numbers, pairs, owner, groups


def _counted(pairs: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different pairs, how often it has each, and where each text's begin."""
    if n < 1 << 63 - 2 * PAIR_BITS:  # both fit into one number, which sorts faster
        key = np.sort(owner << 2 * PAIR_BITS | pairs)
        owner, pairs = key >> 2 * PAIR_BITS, key & ((1 << 2 * PAIR_BITS) - 1)
    else:
        order = np.lexsort((pairs, owner))
        owner, pairs = owner[order], pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return pairs[first], np.diff(np.append(first, len(pairs))), np.searchsorted(owner[first], np.arange(n + 1))


def _aligned(first: str, second: str, digest: bool):
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligning(first, second)
        for batch in batches:
            for part in parts(batch["_text"], PART_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                numbers, pairs, owner, groups = _align_rows(aligned, rows["_text"])
                if digest:
                    shown = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, numbers[0].tolist())]
                else:
                    shown = [bytes(g).decode() for g in groups]
                pairs, times, begins = _counted(pairs, owner, len(rows))
                begins = pa.array(begins.astype(np.int32))
                yield pa.record_batch(
                    [
                        rows["doc_id"], *(pa.array(x) for x in numbers), pa.array(numbers[2]), pa.array(shown, pa.string()),
                        pa.ListArray.from_arrays(begins, pa.array(pairs)),
                        pa.ListArray.from_arrays(begins, pa.array(times.astype(np.int32))),
                    ],
                    names,
                )

    return run


def align_tokens(
    docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", digest: bool = False
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` for every row.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its
    SHA-256, or the empty text where there are no tokens). ``pairs`` are the
    different pairs of ids whose tokens end together, as one number, and
    ``times`` how often each does. Both tokenizers see a space and the text;
    null and empty texts and those that some token sequence does not spell
    byte by byte have no tokens. Rows are taken one by one, so repeated and
    null ids, other columns and an empty table make no difference. A very long
    text is cut into pieces like any other. No shuffle.
    """
    text = whole_text(F.col("text"))
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("_text"))
    return rows.mapInArrow(_aligned(first, second, digest), ALIGNED)


def count_pairs(links: DataFrame) -> DataFrame:
    """``pair, count, best`` of ``pair, times`` rows: the corpus-wide count, and whether no pair of its second id has more."""
    counts = cut_lineage(links.groupBy("pair").agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    most = counts.groupBy(second.alias("_b")).agg(F.max("count").alias("_most"))
    return cut_lineage(
        counts.withColumn("_b", second).join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    )


def scored_alignment(docs: DataFrame, sent_pairs: int = SENT_PAIRS, **how) -> DataFrame:
    """:func:`align_tokens` with ``n_best`` and ``count_sum`` in place of the pairs.

    ``n_best`` counts the links of a text whose id pair is the most frequent
    one of its second id in all of ``docs`` (ties count), ``count_sum`` adds up
    the corpus-wide counts of its links. The alignments are written once; pair
    counts are sent to every task if they are few, else joined by their pair,
    with the frequent ones apart.
    """
    written = cut_lineage(align_tokens(docs, **how).withColumn("_row", F.monotonically_increasing_id()))
    links = written.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("_row", "_l.pairs", "_l.times")
    links = links.toDF("_row", "pair", "times")
    facts = count_pairs(links)
    n = facts.count()
    if n <= sent_pairs:
        told = links.join(F.broadcast(facts), "pair")
    else:
        total = facts.agg(F.sum("count")).first()[0]
        key = F.col("pair").cast("string").cast("binary")
        told = join_facts(links.withColumn("pair", key), facts.withColumn("pair", key), "pair", "count", total)
    sums = told.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    none = F.lit(0).cast("long")
    return (
        written.drop("pairs", "times")
        .join(sums, "_row", "left")
        .withColumn("n_best", F.coalesce("n_best", none))
        .withColumn("count_sum", F.coalesce("count_sum", none))
        .drop("_row")
    )


def alignment_digest(docs: DataFrame) -> DataFrame:
    return scored_alignment(docs, digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
