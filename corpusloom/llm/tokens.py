"""Token counts and token ids that equal a tokenizer's own, for texts of any length.

Ordinary texts are cut at white space where the tokenizer's own splitting is
known to cut too, and each different piece of a batch is encoded once; the ids
of a text are gathered from those of its pieces. Huge texts become overlapping
chunks, dealt out as rows of their own; each chunk is encoded with offsets,
neighbours are spliced at a place where both have a pre-token boundary, and
where there is none the overlap is widened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusloom.session import cut_lineage

from .batches import gather, parts, split_pieces, split_words, texts_with
from .common import whole_text

# A text of more characters than this is counted in chunks.
HUGE = 60_000
CHUNK = 20_000
OVERLAP = 256

# Different pieces of words that a worker remembers.
REMEMBERED = 300_000

# White space and control characters about which patterns differ. They are left to the
# tokenizer, as is what may be a special token.
ODD = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
ODD_FIRST = "\x1c\x1d\x1e\x1f\x85\u1680\u2000\u3000\ufeff"  # one for each first byte in UTF-8


def first_bytes(chars: str) -> np.ndarray:
    """Which bytes begin one of ``chars`` in UTF-8."""
    out = np.zeros(256, bool)
    out[[c.encode()[0] for c in chars]] = True
    return out


def public_path(name: str) -> str:
    """Where a worker finds the tokenizer file called ``name``; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer, one for each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_path(name))
    out.no_truncation()
    out.no_padding()
    return out


class Pieces:
    """Encodes a batch of texts, each different piece once.

    A byte-level pre-tokenizer only puts a single leading space into a token
    with other characters, and looks at most one character ahead of a run of
    white space. So there is a boundary between every non-space and a white
    space after it, and what follows does not depend on what came before. A
    tokenizer that drops white space has the same boundaries. Texts with
    other white space, or with what may be a special token, are encoded whole.
    """

    split = staticmethod(split_pieces)

    def __init__(self, name: str) -> None:
        self.tokenizer = load(name)
        self.odd, self.odd_bytes = ODD + "|<\\|", first_bytes(ODD_FIRST + "<")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self._whole(texts)

    def _pieces(self, texts: pa.Array) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of the different pieces, the number of each piece, and where each text's pieces begin."""
        whole = texts_with(texts, self.odd, self.odd_bytes)
        codes, begins, different = self.split(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts))
        odd = np.flatnonzero(whole)
        ids = self._encode(different.to_pylist()) + self._whole(texts.take(pa.array(odd)).to_pylist())
        codes = np.insert(codes, begins[odd], len(different) + np.arange(len(odd)))  # an odd text is one piece
        return ids, codes, begins + np.concatenate([[0], np.cumsum(whole)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        ids, codes, begins = self._pieces(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[begins])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one more at the end)."""
        ids, codes, begins = self._pieces(texts)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(starts[-1]))
        picked, ends = gather(codes, starts)
        return flat[picked], ends[begins]


# Letters that a lower-casing, composing tokenizer takes one by one.
_LETTERS = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0148\u014a-\u017e]+")


class WordPieces(Pieces):
    """For tokenizers that drop white space and case.

    Letters alone are one pre-token, and normalising them is lower-casing them.
    They can go to the tokenizer's model directly, in the byte-level spelling.
    """

    def __init__(self, name: str) -> None:
        super().__init__(name)
        from tokenizers.pre_tokenizers import ByteLevel

        self.spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters: dict[int, str] = {}
        self.stems: dict[str, list[int]] = {}

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        return split_words(texts, lower=True, kinds=True)

    def _stem(self, letters: str) -> list[int]:
        spelled = letters
        if not letters.isascii():
            for c in set(map(ord, letters)).difference(self.letters):
                self.letters[c] = self.spelling.pre_tokenize_str(chr(c))[0][0]
            spelled = letters.translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(spelled)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        stems, match = self.stems, _LETTERS.fullmatch
        new = [t for t in texts if t not in stems]
        if len(stems) + len(new) > REMEMBERED:
            stems.clear()
            new = texts
        plain = [t for t in new if match(t)]
        stems.update((t, self._stem(t.lower())) for t in plain)
        others = [t for t in new if t not in stems]
        stems.update(zip(others, self._whole(others)))
        return [stems[t] for t in texts]


@lru_cache(maxsize=4)
def pieces_of(name: str) -> Pieces:
    """``word_*`` tokenizers drop white space and case; others are byte-level."""
    return (WordPieces if os.path.basename(name).startswith("word_") else Pieces)(name)


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(name)
        for batch in batches:
            for part in parts(batch["_text"]):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.record_batch(
                    [rows["doc_id"], rows["n_bytes"], pa.array(pieces.counts(rows["_text"]))],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return run


# --- huge texts ---


def _chunks(chunk: int, overlap: int):
    """One row for each chunk; a chunk begins at a multiple of ``chunk`` and reads ``overlap`` more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch["uid"].to_pylist(), batch["text"].to_pylist()):
                starts = list(range(0, max(len(text), 1), chunk))
                # a last chunk that the one before it covers is not needed
                while len(starts) > 1 and starts[-2] + chunk + overlap >= len(text):
                    starts.pop()
                yield pa.record_batch(
                    [
                        pa.array([uid] * len(starts), pa.string()),
                        pa.array(range(len(starts)), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([s == starts[-1] for s in starts]),
                        pa.array([text[s : s + chunk + overlap] if s != starts[-1] else text[s:] for s in starts]),
                    ],
                    ["uid", "number", "start", "is_last", "piece"],
                )

    return run


def boundaries(encoding, length: int, closed: bool, special: int) -> list[tuple[int, int]]:
    """``(place, tokens before it)`` of the pre-token boundaries that are right whatever follows.

    A boundary between two pre-tokens was decided by characters up to the one
    after it, so it must lie before the end of the chunk, and so far before it
    that no special token can reach over it and beyond. ``closed`` says that
    the text ends with the chunk; then every boundary counts.
    """
    out, words, offsets = [], encoding.word_ids, encoding.offsets
    for k in range(1, len(words)):
        if words[k] is None or words[k - 1] is None or words[k] != words[k - 1]:
            out.append((offsets[k][0], k))
    limit = length if closed else length - 1 - special
    return [(p, k) for p, k in out if p <= limit]


@lru_cache(maxsize=4)
def _with_offsets(name: str):
    """The tokenizer with plain offsets, and the length of its longest special token."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = load(name)
    tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True, trim_offsets=False)
    return tokenizer, max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def _edges(name: str, chunk: int):
    """Encode chunks; keep their token count and the boundaries in the parts they share with neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special = _with_offsets(name)
        kind = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            counts, heads, tails = [], [], []
            for start, is_last, text in zip(
                batch["start"].to_pylist(), batch["is_last"].to_pylist(), batch["piece"].to_pylist()
            ):
                e = tokenizer.encode(text, add_special_tokens=False)
                found = [(start + p, k) for p, k in boundaries(e, len(text), is_last, special)]
                shared = len(text) - chunk  # with the next chunk
                counts.append(len(e))
                heads.append([{"place": p, "before": k} for p, k in found if p <= start + max(shared, 0)] if start else [])
                tails.append([] if is_last else [{"place": p, "before": k} for p, k in found if p >= start + chunk])
            yield pa.record_batch(
                [
                    batch["uid"], batch["number"], batch["is_last"], pa.array(counts, pa.int64()),
                    pa.array(heads, kind), pa.array(tails, kind),
                ],
                ["uid", "number", "is_last", "n_tokens", "head", "tail"],
            )

    return run


EDGE_SCHEMA = (
    "uid string, number int, is_last boolean, n_tokens long, "
    "head array<struct<place: long, before: long>>, tail array<struct<place: long, before: long>>"
)


def _spliced(edges: DataFrame) -> DataFrame:
    """``uid, n_tokens`` of each text; null where two neighbours have no boundary in common."""
    order = Window.partitionBy("uid").orderBy("number")
    tail = F.lag("tail").over(order)
    met = F.filter(F.col("head"), lambda h: F.exists(F.col("_tail"), lambda t: t["place"] == h["place"]))
    first = F.get(met, F.lit(0))
    left = F.get(F.filter(F.col("_tail"), lambda t: t["place"] == F.col("_meet.place")), F.lit(0))
    joined = (
        edges.withColumn("_tail", tail)
        .withColumn("_meet", first)
        .withColumn("_skip", F.when(F.col("number") == 0, 0).otherwise(F.col("_meet.before")))
        .withColumn("_until", F.when(F.col("number") == 0, 0).otherwise(left["before"]))
        .withColumn("_end", F.when(F.col("is_last"), F.col("n_tokens")).otherwise(F.lead("_until").over(order)))
    )
    own = F.col("_end") - F.col("_skip")
    return joined.groupBy("uid").agg(
        F.when(F.count(own) == F.count(F.lit(1)), F.sum(own)).alias("n_tokens")
    )


def count_huge(texts: DataFrame, name: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``uid, n_tokens`` for a written table of ``uid, text``.

    Every round handles the texts that could not be spliced before, with an
    overlap four times as wide; an overlap as long as the text always fits.
    """
    done, todo = None, texts
    while True:
        pieces = todo.select("uid", "text").mapInArrow(
            _chunks(chunk, overlap), "uid string, number int, start long, is_last boolean, piece string"
        )
        edges = pieces.repartition(F.col("uid"), F.col("number")).mapInArrow(_edges(name, chunk), EDGE_SCHEMA)
        result = cut_lineage(_spliced(edges))
        fine = result.where("n_tokens IS NOT NULL")
        done = fine if done is None else done.unionByName(fine)
        failed = result.where("n_tokens IS NULL").select("uid")
        if failed.isEmpty():
            return done
        todo, overlap = texts.join(failed, "uid", "left_semi"), overlap * 4
        chunk = max(chunk, overlap)


def count_tokens(
    docs: DataFrame,
    name: str = "byte_bpe_50k.json",
    limit: int = 512,
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``name`` is a byte-level BPE in the format of ``tokenizers``. Null and
    empty texts have no tokens. Nothing else of a row is used, so repeated and
    null ids, further columns and an empty table make no difference. Ordinary
    texts are not shuffled; the huge ones are written once, and only their
    chunks move.
    """
    text: Column = whole_text(F.col("text"))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    ordinary = rows.where(F.length("_text") <= huge).mapInArrow(
        _count(name), "doc_id long, n_bytes long, n_tokens long"
    )
    long_rows = rows.where(F.length("_text") > huge)
    written = cut_lineage(
        long_rows.select(F.expr("uuid()").alias("uid"), "doc_id", "n_bytes", F.col("_text").alias("text"))
    )
    counted = ordinary
    if not written.isEmpty():
        found = count_huge(written, name, chunk, overlap)
        counted = counted.unionByName(
            written.select("uid", "doc_id", "n_bytes").join(found, "uid").select("doc_id", "n_bytes", "n_tokens")
        )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
