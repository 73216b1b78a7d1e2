"""Removal of repeated passages by suffix automata of reference shards.

A window is 35 consecutive words; a word goes if it is covered by a window
whose words also start anywhere else. Each window has an anchor, the run of
eight words in it with the smallest hash, so equal windows have equal anchors.
Neighbouring windows with one anchor make a segment.

1. Anchors are counted over the corpus. A window whose anchor occurs once is
   unique. If an anchor's segments are the same everywhere, by 128 bits of hash
   that is no polynomial of their bytes or words, all its windows are repeated.
2. The other segments are dealt out by anchor to shards of bounded size. A
   task builds the suffix automaton of its shard, the reference, and streams
   the segments through it: the matching statistic of a place is the length
   of the longest run of words ending there that the shard has twice, and
   where it reaches 35 a repeated window ends.
3. An anchor with very many different segments is not given to one task; its
   windows are counted one by one under a 128-bit hash.

An automaton for all tasks would have to be followed by every document once for
each shard of the corpus, which is quadratic; so segments go to their shard's
automaton instead of the automaton to all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

from .batches import mix, parts, split_words, string_hash_pairs, window_hashes
from .common import join_facts, whole_text

WINDOW = 35
ANCHOR = 8
# Words of all segments in a shard, so an automaton has at most twice as many states.
SHARD_WORDS = 40_000
# An anchor with more texts than this is counted window by window.
MANY_TEXTS = 2000
# Texts are handled together up to so many bytes.
PART_BYTES = 4 << 20

UNIFORM, MIXED, MANY = 1, 2, 3
WORD = re.compile("[^\x20\x09-\x0d]+")


def segments(words: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Text number, first and last window (places among all words) and anchor of each segment.

    Of equal smallest hashes the leftmost is the anchor. Anchors of later
    windows lie no further left, so windows with one anchor are neighbours.
    """
    n_windows = len(words) - window + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    grams = window_hashes(words, ANCHOR)
    choice = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1)
    anchor = choice.argmin(axis=1) + np.arange(n_windows)
    inside = np.flatnonzero(owner[:n_windows] == owner[window - 1 :])
    anchor = anchor[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:], len(inside)) - 1] if len(inside) else first
    return owner[first], first, last, grams[anchor[new]]


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of all words in order, and where each text's words begin (one more at the end)."""
    codes, begins, different = split_words(texts)
    one, other = string_hash_pairs(different)
    return one[codes], other[codes], begins


def range_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``first`` up to ``end``, mixed after each word; ranges are short."""
    with np.errstate(over="ignore"):
        out = mix((end - first).astype(np.uint64) + np.uint64(1))
        least = int((end - first).min(initial=1 << 30)) if len(first) else 0
        for k in range(least):
            out = mix((out ^ words[first + k]) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(least, int((end - first).max(initial=0))):
            on = np.flatnonzero(first + k < end)
            out[on] = mix((out[on] ^ words[first[on] + k]) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _anchors(window: int):
    kind = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch["_text"], PART_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                words, others, begins = word_values(rows["_text"])
                text, first, last, anchor = segments(words, begins, window)
                content = [range_hashes(w, first, last + window) for w in (words, others)]
                values = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, *content)], fields=list(kind))
                ends = np.searchsorted(text, np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.record_batch(
                    [rows["doc_id"], rows["node"], pa.ListArray.from_arrays(pa.array(ends), values)],
                    ["doc_id", "node", "anchors"],
                )

    return run


# --- what is known of each text, and what must be looked up ---

OUT = (
    "uid long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, "
    "sure array<struct<first: long, last: long>>, place long, content string, h long, h2 long, weight long, kind int"
)
OUT_TYPES = {
    "uid": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
    "text": pa.string(), "sure": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
    "place": pa.int64(), "content": pa.string(), "h": pa.int64(), "h2": pa.int64(), "weight": pa.int64(), "kind": pa.int32(),
}


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _rows(out: list[dict]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r.get(c) for r in out], t) for c, t in OUT_TYPES.items()], list(OUT_TYPES)
    )


def _split(window: int):
    """Finish the texts that need no automaton; of the others emit the text, segments and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch["_text"], PART_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                # only texts with an anchor that occurs again need their segments
                asked = pc.fill_null(pc.greater(pc.list_value_length(rows["flags"]), 0), False)
                hashes, others, begins = word_values(rows["_text"].filter(asked))
                text, first, last, anchor = segments(hashes, begins, window)
                ends = np.searchsorted(text, np.arange(len(begins)))
                asked = asked.to_numpy(zero_copy_only=False)
                place_of = np.cumsum(asked) - 1
                out, size, many = [], 0, []
                for k, row in enumerate(rows.to_pylist()):
                    words, copies = WORD.findall(row["_text"]), row["n"] or 1
                    own, base = slice(0, 0), 0
                    if asked[k]:
                        own, base = slice(ends[place_of[k]], ends[place_of[k] + 1]), begins[place_of[k]]
                    kinds = {f["h"]: f["kind"] for f in row["flags"] or ()}
                    todo, sure = [], []
                    for h, a, b in zip(
                        anchor[own].view(np.int64).tolist(), (first[own] - base).tolist(), (last[own] - base).tolist()
                    ):
                        if kinds.get(h) == UNIFORM:
                            sure.append({"first": a, "last": b})
                        elif h in kinds:
                            todo.append((h, kinds[h], a, b))
                    done = {"uid": row["uid"], "doc_id": row["doc_id"], "n_words": len(words), "kind": 0}
                    if copies > 1:  # every window occurs in the other copies
                        gone = len(words) if len(words) >= window else 0
                        out.append(done | {"n_removed": gone, "kept_sha256": _sha([] if gone else words)})
                    elif todo:
                        out.append(done | {"text": row["_text"], "sure": sure})
                        size += len(row["_text"])
                    else:
                        out.append(done | _without(words, sure, window))
                    if copies > 1 and row["doc_id"] != row["least_id"]:
                        todo = []  # one of the copies speaks for all
                    weight, uid = (1, row["uid"]) if copies == 1 else (2, None)
                    for h, kind, a, b in todo:
                        if kind == MIXED:
                            content = " ".join(words[a : b + window])
                            out.append({"uid": uid, "place": a, "content": content, "h": h, "weight": weight, "kind": 1})
                            size += len(content)
                            continue
                        many.append((uid, weight, a, np.arange(a, b + 1) + base))
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)
                yield from _windows(many, hashes, others, window)

    return run


def _windows(many: list[tuple], hashes: np.ndarray, others: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """The windows of segments ``uid, weight, first place, places among all words``, hashed together."""
    for low in range(0, len(many), 2000):
        some = many[low : low + 2000]
        at = np.concatenate([m[3] for m in some])
        x, y = (range_hashes(w, at, at + window).view(np.int64).tolist() for w in (hashes, others))
        out, k = [], 0
        for uid, weight, first, places in some:
            for place in range(first, first + len(places)):
                out.append({"uid": uid, "place": place, "h": x[k], "h2": y[k], "weight": weight, "kind": 2})
                k += 1
        yield _rows(out)


def _without(words: list[str], ranges: list[dict], window: int) -> dict:
    """What is left without the words that the windows in ``ranges`` cover."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        gone[r["first"]] += 1
        gone[r["last"] + window] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    kept = [w for w, c in zip(words, covered.tolist()) if not c]
    return {"n_removed": len(words) - len(kept), "kept_sha256": _sha(kept)}


# --- reference shards ---


class SuffixAutomaton:
    """All runs of words of several segments, with how often each occurs."""

    def __init__(self) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split_off(self, p: int, word: str, q: int) -> int:
        """The part of state ``q`` that ends runs of at most ``length[p] + 1`` words."""
        clone = self._state(self.length[p] + 1)
        self.step[clone] = dict(self.step[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split_off(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split_off(p, word, q)
        return new

    def add(self, words: list[str], weight: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += weight

    def finish(self) -> None:
        """Occurrences of a run are occurrences of its ends, too."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def statistics(self, words: list[str]) -> list[int]:
        """At each place of an added segment, the longest run ending there that occurs twice."""
        out, state = [], 0
        for k, word in enumerate(words):
            state = self.step[state][word]
            at = state
            while at and self.count[at] < 2:
                at = self.link[at]
            out.append(k + 1 if at == state else self.length[at])
        return out


def _shard(window: int):
    def run(table):
        contents = table["content"].to_pylist()
        weights: dict[str, int] = {}
        for content, weight in zip(contents, table["weight"].to_pylist()):
            weights[content] = weights.get(content, 0) + weight
        automaton = SuffixAutomaton()
        for content, weight in weights.items():
            automaton.add(content.split(" "), weight)
        automaton.finish()
        found = {}
        for content in weights:
            longest = automaton.statistics(content.split(" "))
            found[content] = [k - window + 1 for k, n in enumerate(longest) if n >= window]
        uids, places = [], []
        for uid, place, content in zip(table["uid"].to_pylist(), table["place"].to_pylist(), contents):
            if uid is not None:
                uids += [uid] * len(found[content])
                places += [place + k for k in found[content]]
        return pa.table({"uid": pa.array(uids, pa.int64()), "place": pa.array(places, pa.int64())})

    return run


def _finish(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = WORD.findall(row["text"])
                ranges = (row["sure"] or []) + [{"first": p, "last": p} for p in row["places"] or ()]
                rows.append({"doc_id": row["doc_id"], "n_words": len(words)} | _without(words, ranges, window))
            yield pa.record_batch(
                [pa.array([r[c] for r in rows], OUT_TYPES[c]) for c in RESULT], RESULT
            )

    return run


RESULT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, many_texts: int = MANY_TEXTS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    Null and empty texts have no words. A text that other rows have, too, is
    repeated as a whole if it has a window at all. Ids play no part, so null
    and repeated ids make no difference; neither do other columns, and an
    empty table stays empty. A very long text is held whole by one task, with
    about a hundred bytes for each of its words.
    """
    text = whole_text(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("_text")
    )
    found = rows.mapInArrow(_anchors(window), "doc_id long, node binary, anchors array<struct<h: long, c: long, d: long>>")
    nodes = cut_lineage(
        found.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id"), F.first("anchors").alias("anchors")
        )
    )
    each = nodes.select("node", "n", F.inline("anchors")).withColumn("key", F.col("h").cast("string").cast("binary"))
    counted = cut_lineage(
        each.groupBy("key")
        .agg(
            F.sum("n").alias("times"), F.count(F.lit(1)).alias("texts"),
            ((F.min("c") == F.max("c")) & (F.min("d") == F.max("d"))).alias("same"),
        )
        .where("times > 1")
        .withColumn("kind", F.when(F.col("same"), UNIFORM).when(F.col("texts") <= many_texts, MIXED).otherwise(MANY))
        .select("key", "texts", "kind")
    )
    total = nodes.agg(F.sum(F.size("anchors"))).first()[0] or 0
    flagged = join_facts(each.select("key", "node", "h"), counted, "key", "texts", total).where("kind IS NOT NULL")
    flags = flagged.groupBy("node").agg(F.collect_set(F.struct("h", "kind")).alias("flags"))
    facts = cut_lineage(
        nodes.select("node", "n", "least_id").join(flags, "node", "left").where("n > 1 OR flags IS NOT NULL")
    )
    n_rows = nodes.agg(F.sum("n")).first()[0] or 0
    told = join_facts(rows, facts, "node", "n", n_rows).withColumn("uid", F.monotonically_increasing_id())
    parted = cut_lineage(told.select("uid", "doc_id", "_text", "n", "least_id", "flags").mapInArrow(_split(window), OUT))

    mixed = parted.where("kind = 1").select("uid", "place", "content", "h", "weight")
    size = mixed.agg(F.sum(F.length("content") - F.length(F.translate("content", " ", "")) + 1)).first()[0] or 0
    shard = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-size // shard_words))))
    by_shard = mixed.withColumn("shard", shard).groupBy("shard").applyInArrow(_shard(window), "uid long, place long")

    single = parted.where("kind = 2").select(
        "uid", "place", "weight", F.concat(F.hex("h"), F.lit("."), F.hex("h2")).cast("binary").alias("key")
    )
    times = cut_lineage(
        single.groupBy("key").agg(F.sum("weight").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 1")
    )
    by_window = join_facts(single, times, "key", "rows", single.count()).where("times > 1 AND uid IS NOT NULL")
    places = by_shard.unionByName(by_window.select("uid", "place")).groupBy("uid").agg(F.collect_list("place").alias("places"))

    known = parted.where("kind = 0 AND kept_sha256 IS NOT NULL").select(*RESULT)
    asked = parted.where("kind = 0 AND kept_sha256 IS NULL").select("uid", "doc_id", "text", "sure")
    finished = (
        asked.join(places, "uid", "left")
        .select("doc_id", "text", "sure", "places")
        .mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
    return known.unionByName(finished)


REPEATS_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, unnest(hashes) AS h, unnest(range(1, len(hashes) + 1)) AS k FROM (
    SELECT r, list_transform(range(1, greatest(len(words) - {WINDOW - 2}, 1)),
      lambda k: md5(array_to_string(list_slice(words, k, k + {WINDOW - 1}), ' '))) AS hashes FROM texts)),
starts AS (SELECT r, k FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM texts),
marked AS (
  SELECT e.r, e.k, e.word, coalesce(e.k - max(s.k) OVER (PARTITION BY e.r ORDER BY e.k) < {WINDOW}, false) AS gone
  FROM each e LEFT JOIN starts s ON s.r = e.r AND s.k = e.k),
counted AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counted USING (r)"""
