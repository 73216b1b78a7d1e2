"""Groups of nearly equal sets by set-relation skipping.

A document is the set of its word n-grams. Two documents link when their sets
have a Jaccard similarity of at least a threshold; a component is what links
connect. Equal sets are one node from the start.

*Index lists.* Each set is ordered so that n-grams which are common in the
corpus come last (by a table of counts of fixed size), and only as many as can
hold the first common n-gram of a similar pair go into the index. A list, kept
in order of size, is walked in blocks; a block is skipped as a whole if its
smallest position and its sizes rule out enough common n-grams behind the one
at hand. What is left is compared by a histogram of each set, whose differences
never exceed the sets' own difference.

*Derived answers.* Sets that are highly similar to a representative are kept as
their difference to it. The difference of two of them follows from these small
differences alone, as ``|Y ^ Z| = |dY| + |dZ| - 2 |dY & dZ|``, so a set's
answers inside such a family are derived from the representative's without
another look at the sets. Only members that the representative's own answers
leave in another component need any. Pairs across families are verified on
their whole sets. No list, family or component is turned into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import connected_components
from corpusloom.operators.skew import hot_from_counts, salted_join
from corpusloom.session import cut_lineage

from .batches import mix, parts, split_words, string_hashes, window_hashes
from .common import join_facts, whole_text
from .needed import needed_texts

WORDS = 3
# Linked: common * 100 >= 90 * union. As alike as that to a representative: common * 100 >= 75 * union.
SIMILARITY = (90, 100)
FAMILY = (75, 100)

# The table of counts: n-grams share a counter by the first bits of their hash. Its size is fixed.
COUNT_BITS = 20
CHUNK = 1024

# A list that may hold more sets, or a family that does, is handled in pairs of blocks of so many.
BLOCK = 2048
ROWS_PER_SALT = 2000
# Entries of a list that are skipped together, and pairs that are looked at together.
SKIP, PAIRS = 16, 1 << 18

# A histogram has a bin for so many elements, a power of two of them and this many at least; its
# counts are known modulo 256.
PER_BIN, LEAST_BINS = 80, 16
# Two sets of a family differ by less than this share of what chance lets histograms differ by.
CHANCE = 0.6



# --- sets ---


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's different n-grams; a shorter text is one."""
    codes, begins, different = split_words(texts, lower=True)
    hashed = string_hashes(different)[codes]
    grams = window_hashes(hashed, words)
    edges = begins.tolist()
    for i, j in zip(edges, edges[1:]):
        if j - i >= words:
            yield np.unique(grams[i : j - words + 1])
        else:
            yield window_hashes(hashed[i:j], j - i)[: 1 if j > i else 0]


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch[column]):
            yield batch.slice(part.start, part.stop - part.start)


def _prefix(n: int, similarity: tuple[int, int]) -> int:
    num, den = similarity
    return n - -(-num * n // den) + 1


def _least_common(sizes: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """So many common elements two sets need whose sizes add up to ``sizes``."""
    num, den = similarity
    return -(-num * sizes // (num + den))


def most_apart(sizes: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """By so many elements two linked sets may differ whose sizes add up to ``sizes``."""
    return sizes - 2 * _least_common(sizes, similarity)


# --- the table of counts ---


def _counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for rows in _rows(batches, "_text"):
            sets = list(shingle_sets(rows["_text"], words))
            if sets:
                total += np.bincount(np.concatenate(sets) >> np.uint64(64 - COUNT_BITS), minlength=len(total))
        for chunk in range(len(total) // CHUNK):
            own = total[chunk * CHUNK : (chunk + 1) * CHUNK]
            at = np.flatnonzero(own)
            if len(at):
                yield _counted(chunk, at, own[at])

    return run


def _counted(chunk: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    packed = [at.astype("<u2").tobytes(), n.astype("<u4" if n.max() < 1 << 32 else "<u8").tobytes()]
    return pa.record_batch([pa.array([chunk], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["chunk", "at", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, at, n in zip(*(batch[c].to_pylist() for c in ("chunk", "at", "n"))):
            at = np.frombuffer(at, "<u2")
            total = totals.setdefault(chunk, np.zeros(CHUNK, np.int64))
            total[at] += np.frombuffer(n, "<u4" if len(n) == 4 * len(at) else "<u8").astype(np.int64)
    for chunk, total in totals.items():
        at = np.flatnonzero(total)
        yield _counted(chunk, at, total[at])


def gram_counts(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many of the sets hold an n-gram whose hash begins with the same bits: an upper bound for each n-gram."""
    schema = "chunk int, at binary, n binary"
    found = texts.mapInArrow(_counts(words), schema).repartition("chunk").mapInArrow(_summed, schema).collect()
    out = np.zeros(1 << COUNT_BITS, np.int64)  # the table has this size for every corpus
    for row in found:
        at = np.frombuffer(row["at"], "<u2").astype(np.int64) + row["chunk"] * CHUNK
        out[at] = np.frombuffer(row["n"], "<u4" if len(row["n"]) == 4 * len(at) else "<u8")
    return out


# --- index entries ---

SETS = (
    "doc_id long, text_key binary, node_key binary, n int, prefix array<long>, blocks array<int>, shape binary"
)


def _histogram(grams: np.ndarray) -> np.ndarray:
    bins = LEAST_BINS
    while bins * PER_BIN < len(grams):
        bins *= 2
    return np.bincount((grams & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8)


class Histograms:
    """Histograms of several lengths, and lower bounds of how much sets differ."""

    def __init__(self, shapes: list[bytes]) -> None:
        self.length = np.array([len(s) for s in shapes], np.int64)
        self.at = np.zeros(len(shapes), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            self.at[own] = np.arange(len(own))
            rows = np.frombuffer(b"".join(shapes[k] for k in own.tolist()), np.uint8).reshape(-1, n)
            self.whole[n], self.half[n] = rows, rows[:, : n // 2] + rows[:, n // 2 :]

    def _rows(self, k: np.ndarray, n: int) -> np.ndarray:
        if (self.length[k] == n).all():
            return self.whole[n][self.at[k]]
        out = np.empty((len(k), n), np.uint8)
        for length, rows in ((n, self.whole.get(n)), (2 * n, self.half.get(2 * n))):
            own = self.length[k] == length
            if own.any():
                out[own] = rows[self.at[k[own]]]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At least by so many elements two sets differ, and the bins compared. Their lengths are alike."""
        bins = np.minimum(self.length[i], self.length[j])
        out = np.zeros(len(i), np.int64)
        for n in np.unique(bins).tolist():
            own = np.flatnonzero(bins == n)
            gap = self._rows(i[own], n) - self._rows(j[own], n)  # modulo 256
            out[own] = np.minimum(gap, np.uint8(0) - gap).sum(axis=1, dtype=np.int64)
        return out, bins


def _index(counts, words: int, similarity: tuple[int, int], block: int):
    names = [c.split()[0] for c in SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        mean = max(table.sum() / len(table), 1)
        common = np.maximum(np.log2(np.maximum(table, 1) / mean).astype(np.int64), 0)
        for rows in _rows(batches, "_text"):
            keys, sizes, prefixes, blocks, shapes = [], [], [], [], []
            for grams in shingle_sets(rows["_text"], words):
                n = len(grams)
                at = (grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                first = np.lexsort((mix(grams), common[at]))[: _prefix(n, similarity) if n else 0]
                keys.append(blake2b(grams.tobytes(), digest_size=16).digest())
                sizes.append(n)
                prefixes.append(grams[first])
                blocks.append(-(-table[at[first]] // block))
                shapes.append(_histogram(grams).tobytes())
            begins = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
            yield pa.record_batch(
                [
                    rows["doc_id"], rows["text_key"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(begins, pa.array(np.concatenate(prefixes).view(np.int64))),
                    pa.ListArray.from_arrays(begins, pa.array(np.concatenate(blocks).astype(np.int32))),
                    pa.array(shapes, pa.binary()),
                ],
                names,
            )

    return run


def index_entries(nodes: DataFrame) -> DataFrame:
    """``list, pos, node, n``: one row for each node and list; large lists are pairs of blocks."""
    entry = F.explode(
        F.zip_with(
            F.sequence(F.lit(0), F.size("prefix") - 1),
            F.arrays_zip("prefix", "blocks"),
            lambda k, e: F.struct(k.alias("pos"), e["prefix"].alias("gram"), F.greatest(e["blocks"], F.lit(1)).alias("blocks")),
        )
    )
    flat = nodes.where("n > 0").select("node", "n", entry.alias("_e"))
    block = F.pmod(F.xxhash64("node"), F.col("_e.blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_e.blocks") - 1))
    large = flat.where("_e.blocks > 1").select("*", block.alias("_block"), other.alias("_other"))
    pair = F.xxhash64("_e.gram", F.least("_block", "_other"), F.greatest("_block", "_other"))
    columns = [F.col("_e.pos").alias("pos"), "node", "n"]
    small = flat.where("_e.blocks = 1").select(F.col("_e.gram").alias("list"), *columns)
    return small.unionByName(large.select(pair.alias("list"), *columns))


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of several rows that begin and end with whole lists; the rows come in order of ``list``."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        lists = table["list"].to_numpy()
        cut = int(np.flatnonzero(lists == lists[-1])[0])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _shared(table: pa.Table) -> dict[str, np.ndarray]:
    """Columns of the lists that hold several rows; histograms as they are."""
    lists = table["list"].to_numpy()
    more = np.zeros(len(lists), bool)
    more[1:] = lists[1:] == lists[:-1]
    more[:-1] |= more[1:]
    out = {c: table[c].to_numpy()[more] for c in table.column_names if c != "shape"}
    if "shape" in table.column_names:
        out["shape"] = table["shape"].filter(pa.array(more)).to_pylist()
    return out


def list_pairs(rows: dict[str, np.ndarray], similarity: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a list that sizes and positions do not rule out, a bounded number at a time.

    Rows come by list, then size. For each row the blocks of the rows behind it
    that are not too large are looked at; in a block nothing has more elements
    behind the shared one than its largest size and smallest position allow.
    """
    n, pos = rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    if not len(n):
        return
    number = np.concatenate([[0], np.cumsum(rows["list"][1:] != rows["list"][:-1])])
    num, den = similarity
    end = np.searchsorted((number << 32) | n, (number << 32) | np.minimum(n * den // num, (1 << 32) - 1), "right")
    starts = np.arange(0, len(n), SKIP)
    smallest, largest = n[starts], np.maximum.reduceat(n, starts)
    smallest = np.minimum.reduceat(n, starts)
    behind = largest - np.minimum.reduceat(pos, starts)
    here = np.arange(len(n))
    first, past = (here + 1) // SKIP, -(-end // SKIP)
    count = np.where(end > here + 1, past - first, 0)
    reach = np.concatenate([[0], np.cumsum(count)])
    step = max(1, PAIRS // SKIP)
    for low in range(0, int(reach[-1]), step):
        k = np.arange(low, min(low + step, int(reach[-1])))
        i = np.searchsorted(reach, k, "right") - 1
        block = first[i] + k - reach[i]
        most = np.minimum(n[i] - pos[i], behind[block])
        # the sizes in the first and last block may be those of another list; they only keep it from being skipped
        open_ = most >= _least_common(n[i] + np.minimum(smallest[block], n[i]), similarity)
        i, block = i[open_], block[open_]
        j = (block * SKIP)[:, None] + np.arange(SKIP)
        i = np.repeat(i, SKIP)
        j = j.ravel()
        fits = (j > i) & (j < end[i])
        i, j = i[fits], j[fits]
        fits = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= _least_common(n[i] + n[j], similarity)
        yield i[fits], j[fits]


ENTRY = "list long, pos int, node long, n int"


def _compatible(similarity: tuple[int, int]):
    """Entries for which sizes and positions leave a partner in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            rows = _shared(table)
            met = np.zeros(len(rows["n"]), bool)
            for i, j in list_pairs(rows, similarity):
                met[i] = met[j] = True
            if met.any():
                yield pa.record_batch([pa.array(v[met]) for v in rows.values()], list(rows))

    return run


def _sizes(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (rows["n"][i] + rows["n"][j]).astype(np.int64)


LIVE = f"{ENTRY}, shape binary, centre long"


def _live(similarity: tuple[int, int], family: tuple[int, int]):
    """Entries with a likely partner in their list, and the most connected one among their partners and themselves.

    A likely partner is one whose histogram does not rule out a link. To be
    connected, histograms also have to be nearer than chance brings them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            rows = _shared(table)
            shapes, near = Histograms(rows["shape"]), []
            live = np.zeros(len(rows["n"]), bool)
            for i, j in list_pairs(rows, similarity):
                apart, bins = shapes.apart(i, j)
                sizes = _sizes(rows, i, j)
                likely = apart <= most_apart(sizes, similarity)
                live[i[likely]] = live[j[likely]] = True
                # the mean difference of two counts of a bin that have nothing to do with each other, for all bins
                chance = CHANCE * np.sqrt(2 / np.pi * sizes * bins)
                close = apart <= np.minimum(most_apart(sizes, family), chance)
                live[i[close]] = live[j[close]] = True
                near.append((i[close], j[close]))
            if not live.any():
                continue
            i, j = (np.concatenate(x) for x in zip(*near))
            size = len(rows["n"])
            degree = np.bincount(i, minlength=size) + np.bincount(j, minlength=size)
            rank = np.empty(size, np.int64)
            rank[np.lexsort((-rows["node"], degree))] = np.arange(size)
            best = rank.copy()
            np.maximum.at(best, i, rank[j])
            np.maximum.at(best, j, rank[i])
            centre = rows["node"][np.argsort(rank)][best]
            columns = [pa.array(rows[c][live]) for c in ("list", "pos", "node", "n")]
            shape = pa.array(rows["shape"], pa.binary()).filter(pa.array(live))
            yield pa.record_batch([*columns, shape, pa.array(centre[live])], [c.split()[0] for c in LIVE.split(", ")])

    return run


CLASSED = f"{ENTRY}, shape binary, class long, family long"


def _across(similarity: tuple[int, int]):
    """Likely pairs of different classes and families of a list, once for each table of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            rows = _shared(table)
            shapes, node = Histograms(rows["shape"]), rows["node"]
            for i, j in list_pairs(rows, similarity):
                other = rows["class"][i] != rows["class"][j]
                other &= (rows["family"][i] != rows["family"][j]) & (rows["family"][i] != node[j]) & (rows["family"][j] != node[i])
                i, j = i[other], j[other]
                likely = shapes.apart(i, j)[0] <= most_apart(_sizes(rows, i, j), similarity)
                i, j = i[likely], j[likely]
                pairs = np.unique(np.sort(np.stack([node[i], node[j]], axis=1), axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


# --- verification ---


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, "text"):
            sets = pa.array([s.tobytes() for s in shingle_sets(rows["text"], words)], pa.binary())
            yield pa.record_batch([rows["node"], rows["a"], sets], ["node", "a", "grams"])

    return run


SETS_OF = "node long, a long, grams binary"
DIFFERENCES = "a long, b long, n_a int, n_b int, apart int, difference binary"


def _differences(most: Callable):
    """Differences of each ``b`` to its ``a``, whose own row (without ``b``) comes first; null if they are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out = []
            for a, b, grams in zip(*(batch[c].to_pylist() for c in ("a", "b", "grams"))):
                grams = np.frombuffer(grams, np.uint64)
                if b is None:
                    at, own = a, grams
                    continue
                if at != a:
                    raise ValueError(f"the set of {a} is missing")
                apart = np.setxor1d(own, grams, assume_unique=True)
                close = len(apart) <= most(len(own) + len(grams))
                out.append((a, b, len(own), len(grams), len(apart), apart.tobytes() if close else None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            names = [c.split()[0] for c in DIFFERENCES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return run


def differences(members: DataFrame, sets: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """``DIFFERENCES`` of pairs ``a, b`` that bring the set of ``b`` as ``grams``.

    Each pair sends one set to its ``a``, whose own set goes there once; an
    ``a`` with many pairs is split, and a copy of its set goes to each part.
    """
    counts = cut_lineage(members.groupBy("a").agg(F.count(F.lit(1)).alias("_rows")))
    hot = F.broadcast(hot_from_counts(counts, ["a"], "_rows", ROWS_PER_SALT))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = members.join(hot, "a", "left")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("_salt"), "b", "grams")
    centres = counts.select("a").join(sets.select(F.col("node").alias("a"), "grams"), "a").join(hot, "a", "left")
    centres = centres.select(
        "a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), F.lit(None).cast("long").alias("b"), "grams"
    )
    together = dealt.unionByName(centres).repartition("a", "_salt").sortWithinPartitions("a", "_salt", "b")
    return together.mapInArrow(_differences(lambda n: int(most_apart(n, keep))), DIFFERENCES)


def linked(found: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    num, den = similarity
    total = F.col("n_a") + F.col("n_b")
    # common * den >= num * union, with common = (total - apart) / 2 and union = (total + apart) / 2
    return found.where((total - F.col("apart")) * den >= (total + F.col("apart")) * num).select("a", "b")


# --- families ---


def _derived(similarity: tuple[int, int]):
    """Links between a family's members of different classes, from their differences to the representative.

    A link makes the two classes one for what follows, so there are fewer links than classes.
    """

    def run(key, table):  # without hints, from which Spark would guess the kind of function
        nodes, sizes = table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        different, label = np.unique(table["class"].to_numpy(), return_inverse=True)
        block = table["block"].to_numpy()
        grams = [np.frombuffer(d or b"", np.uint64) for d in table["difference"].to_pylist()]
        length = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        element = np.unique(flat, return_inverse=True)[1]
        order = np.argsort(element, kind="stable")
        holders = np.repeat(np.arange(len(nodes)), length)[order]
        begins = np.searchsorted(element[order], np.arange(element.max() + 2 if len(element) else 1))
        edges = np.concatenate([[0], np.cumsum(length)])
        home = next(iter(np.flatnonzero(different == table["home"][0].as_py())), -1)  # may be in other blocks
        first, second = key[1].as_py(), key[2].as_py()
        a, b = [], []
        for k in np.flatnonzero(label != home).tolist():
            if block[k] not in (first, second):
                continue
            there = second if block[k] == first else first
            lists = element[edges[k] : edges[k + 1]]
            shared = np.zeros(len(nodes), np.int64)
            if len(lists):
                with_it = np.concatenate([holders[begins[e] : begins[e + 1]] for e in lists.tolist()])
                shared = np.bincount(with_it, minlength=len(nodes))
            apart = length[k] + length - 2 * shared
            near = (apart <= most_apart(sizes[k] + sizes, similarity)) & (label != label[k]) & (block == there)
            found = np.flatnonzero(near)
            classes, at = np.unique(label[found], return_index=True)  # one link to each class will do
            for j in found[at].tolist():
                a.append(nodes[k])
                b.append(nodes[j])
            if len(classes):
                label[np.isin(label, classes)] = label[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def derived_links(families: DataFrame, labels: DataFrame, similarity: tuple[int, int], block: int) -> DataFrame:
    """Links inside families that join classes.

    ``families`` are differences ``DIFFERENCES`` to representatives ``a``.
    Members in the representative's class need no answers of their own; each
    other one is compared with its whole family, large ones in pairs of blocks.
    """
    members = families.select(F.col("a").alias("family"), F.col("b").alias("node"), F.col("n_b").alias("n"), "difference")
    centres = families.groupBy("a").agg(F.first("n_a").alias("n")).select(
        F.col("a").alias("family"), F.col("a").alias("node"), "n", F.lit(None).cast("binary").alias("difference")
    )
    rows = members.unionByName(centres).join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = cut_lineage(rows)
    home = F.max(F.when(F.col("node") == F.col("family"), F.col("class")))
    shapes = rows.groupBy("family").agg(
        home.alias("home"), F.min("class").alias("_low"), F.max("class").alias("_high"), F.count(F.lit(1)).alias("_rows")
    )
    mixed = cut_lineage(shapes.where("_low <> _high").select("family", "home", "_rows"))
    hot = hot_from_counts(mixed, ["family"], "_rows", ROWS_PER_SALT)
    placed = (
        salted_join(rows, mixed, ["family"], hot=hot)
        .withColumn("_blocks", F.ceil(F.col("_rows") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("first", F.least("block", "_other"))
        .withColumn("second", F.greatest("block", "_other"))
        .drop("_rows", "_blocks", "_other")
    )
    return placed.groupBy("family", "first", "second").applyInArrow(_derived(similarity), "a long, b long")


# --- the join ---


def node_classes(
    rows: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int], family: tuple[int, int], block: int
) -> DataFrame:
    """``node, class`` of the nodes that are linked to another."""
    by_list = lambda entries: entries.repartition("list").sortWithinPartitions("list", "n")
    entries = cut_lineage(by_list(index_entries(nodes)).mapInArrow(_compatible(similarity), ENTRY))
    shaped = entries.join(nodes.select("node", "shape"), "node").select("list", "pos", "node", "n", "shape")
    live = cut_lineage(by_list(shaped).mapInArrow(_live(similarity, family), LIVE))
    votes = cut_lineage(live.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("_n")))
    score = votes.groupBy("centre").agg(F.sum("_n").alias("_score"))
    chosen = salted_join(votes, score, ["centre"]).groupBy("node").agg(
        F.max(F.struct("_score", (-F.col("centre")).alias("first"))).alias("_best")
    )
    centre = F.nullif(-F.col("_best.first"), F.col("node")).alias("a")
    involved = cut_lineage(chosen.select("node", centre).join(nodes.select("node", "text_key"), "node"))
    sets = cut_lineage(needed_texts(rows, involved, "text_key").select("node", "a", "text").mapInArrow(_sets_of(words), SETS_OF))

    members = sets.where("a IS NOT NULL").select("a", F.col("node").alias("b"), "grams")
    answers = cut_lineage(differences(members, sets, family))
    links = linked(answers, similarity)
    families = answers.where("difference IS NOT NULL")
    labels = connected_components(links)
    links = cut_lineage(links.unionByName(derived_links(families, labels, similarity, block)))
    labels = connected_components(links)

    classed = (
        live.drop("centre")
        .join(labels, "node", "left")
        .join(families.select(F.col("b").alias("node"), F.col("a").alias("family")), "node", "left")
        .withColumn("class", F.coalesce("class", "node"))
        .withColumn("family", F.coalesce("family", "node"))
        .select(*(c.split()[0] for c in CLASSED.split(", ")))
    )
    across = cut_lineage(by_list(classed).mapInArrow(_across(similarity), "a long, b long").distinct())
    found = salted_join(across, sets.select(F.col("node").alias("b"), "grams"), ["b"], rows_per_salt=ROWS_PER_SALT)
    more = cut_lineage(linked(differences(found, sets, family), similarity))
    return labels if more.isEmpty() else connected_components(links.unionByName(more))


def similar_sets(
    docs: DataFrame,
    words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
    family: tuple[int, int] = FAMILY,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A-Z count as a-z, and words are what lies between white space. Documents
    link if ``common * similarity[1] >= similarity[0] * union`` holds for the
    sets of their ``words``-grams; a text of fewer words is one n-gram of its
    own kind. ``component_id`` is the smallest doc_id reachable by links; null
    ids count as larger than all others, and a component without other ids has
    none. Null, empty and blank texts have empty sets and are linked with
    nothing, not even with each other: each of their rows has its own id.
    Repeated rows are documents like others. Other columns are not used, and an
    empty table stays empty. N-grams are compared by 64-bit hashes. A very long
    text is held whole by one task, in about sixty bytes for each of its words.
    """
    if family[0] * similarity[1] > similarity[0] * family[1]:
        raise ValueError("a family must not be narrower than a link")
    spark = docs.sparkSession
    text = whole_text(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("_text")
    )
    counts = spark.sparkContext.broadcast(gram_counts(rows.select("_text"), words))
    sets = cut_lineage(rows.mapInArrow(_index(counts, words, similarity, block), SETS))
    shape = [F.first(c).alias(c) for c in ("text_key", "n", "prefix", "blocks", "shape")]
    nodes = cut_lineage(
        sets.where("n > 0")
        .groupBy("node_key")
        .agg(*shape, F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("smallest"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    labels = node_classes(rows, nodes, words, similarity, family, block)
    known = nodes.select("node_key", "node", "rows", "smallest").join(labels, "node", "left")
    known = cut_lineage(known.withColumn("class", F.coalesce("class", "node")).drop("node"))
    smallest = known.groupBy("class").agg(F.min("smallest").alias("component_id"))
    facts = cut_lineage(known.drop("smallest").join(smallest, "class").drop("class"))
    total = facts.agg(F.sum("rows")).first()[0] or 0
    found = join_facts(sets.where("n > 0").select("doc_id", "node_key", "n"), facts, "node_key", "rows", total)
    alone = sets.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"]
    return found.select(*columns).unionByName(alone.select(*columns))


SETS_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {WORDS} THEN list_transform(range(1, len(words) - {WORDS - 2}),
      lambda k: array_to_string(list_slice(words, k, k + {WORDS - 1}), ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS gram FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {SIMILARITY[1]} * c.n >= {SIMILARITY[0]} * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(t.doc_id, coalesce(min(r.b), t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = t.doc_id GROUP BY t.doc_id"""
