"""Near-duplicate groups by ProbMinHash, banding and verification.

A text's shingles (five words, weighted by how often they occur) each emit a
Poisson process of points whose rate is the weight; a point goes to a random
component of the signature, which keeps its earliest point. An element stops
when its next point is later than the latest component (early termination).
Two signatures agree in a component with the probability Jaccard similarity of
their shingles. Bands of components put likely pairs into buckets.

No bucket is turned into all its pairs. First every text is compared with one
central text, the most connected one that its buckets lead to. Texts that are
similar to the same one are a family, in which each is kept as its differences
to the central text; similarities inside a family follow from these
differences, so members that their central text leaves in another class are
compared with the whole family in one place and only links come out. Then, in
buckets that still hold several classes, members outside the largest class
propose those members of other classes and families that look most similar by
signature, a few at first and more in each round, until nothing is left to
propose. Every proposed pair is verified on its texts. Texts that are equal
are one node from the start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import connected_components
from corpusloom.operators.skew import hot_from_counts, hot_keys, salted_join
from corpusloom.session import cut_lineage

from .batches import mix, parts, split_words, string_hashes, window_hashes
from .common import join_facts, whole_text
from .needed import among, needed_texts, possible

SHINGLE = 5
SIMILARITY = 0.8
# At a similarity of 0.8 a pair meets in none of the buckets with probability 3e-6.
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
# Signatures propose so many pairs that one of the wanted similarity is left out with at most this
# probability, that of the banding at 0.8.
LEFT_OUT = 3e-6
# Partners that a member proposes in one bucket in the first round, and times more in each later one.
PARTNERS, MORE_PARTNERS = 2, 32
# A bucket with more members is compared in pairs of blocks of so many.
BLOCK = 4096
ROWS_PER_SALT = 5000
# So many steps a member's central node is followed to its own.
JUMPS = 2
# Texts are of one family if they are as similar as this to its central text.
FAMILY = 0.4
# Texts are made into signatures together up to so many bytes.
PART_BYTES = 4 << 20

SKETCH = "doc_id long, node binary, bands array<long>, sketch binary"


def weighted_shingles(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each different shingle; a shorter text is one shingle."""
    n = np.diff(begins)
    owner = np.repeat(np.arange(len(n)), n)
    grams = window_hashes(words, SHINGLE)
    whole = owner[: len(grams)] == owner[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    text, value = owner[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = [window_hashes(words[begins[k] : begins[k + 1]], n[k]) for k in short]
        text, value = np.concatenate([text, short]), np.concatenate([value, *own])
    # 48 bits of the hash are enough inside one text, and sort together with its number
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(48)).astype(np.int64), mix(key[first] & np.uint64((1 << 48) - 1)), count


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's begin (one more at the end)."""
    codes, begins, different = split_words(texts)
    return string_hashes(different)[codes], begins


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``n x COMPONENTS`` elements that come first; 0 for texts without any."""
    first = np.full(n * COMPONENTS, np.inf)
    found = np.zeros(n * COMPONENTS, np.uint64)
    time, number = np.zeros(len(text)), 0
    scale = 1.0 / weight
    while len(text):
        # the next points of each element, several at once when few elements are left
        width = int(np.clip(300_000 // len(text), 1, 64))
        with np.errstate(over="ignore"):
            step = np.arange(number, number + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            random = mix(element[:, None] + step[None, :])
            component = ((mix(random ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(COMPONENTS)) >> np.uint64(32)
        gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale[:, None]
        points = np.cumsum(gap, axis=1) + time[:, None]
        cell = (text[:, None] * COMPONENTS + component.astype(np.int64)).ravel()
        flat = points.ravel()
        np.minimum.at(first, cell, flat)
        won = flat == first[cell]
        found[cell[won]] = np.repeat(element, width)[won]
        latest = first.reshape(n, COMPONENTS).max(axis=1)
        time, number = points[:, -1], number + width
        going = time < latest[text]
        text, element, scale, time = text[going], element[going], scale[going], time[going]
    return found.reshape(n, COMPONENTS)


def band_hashes(found: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found), BANDS), np.uint64)
    rows = found.reshape(len(found), BANDS, ROWS)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * np.uint64(0x100000001B3) + rows[:, :, k] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return out.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch["_text"], PART_BYTES):
            rows = batch.slice(part.start, part.stop - part.start)
            words, begins = word_values(rows["_text"])
            text, element, weight = weighted_shingles(words, begins)
            found = signatures(text, element, weight, len(rows))
            has = np.diff(begins) > 0
            bands = band_hashes(found)[has]
            small = (found & np.uint64(0xFF)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(bands.ravel())
            )
            yield pa.record_batch(
                [rows["doc_id"], rows["node"], lists, pa.array([r.tobytes() for r in small], pa.binary())],
                ["doc_id", "node", "bands", "sketch"],
            )


# --- verification ---


def shingles(text: str) -> Counter:
    words = text.translate(_BLANK).split(" ")
    words = [w for w in words if w]
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE))))


_BLANK = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def probability_jaccard(x: Counter, y: Counter) -> float:
    """The sum over common elements of ``1 / sum_j max(x_j / x_i, y_j / y_i)``.

    For element i the maximum is ``y_j / y_i`` where ``y_j / x_j`` is above its
    own, else ``x_j / x_i``; with elements in the order of that ratio both
    sums are running sums.
    """
    common = x.keys() & y.keys()
    only_x = sum(n for s, n in x.items() if s not in common)
    only_y = sum(n for s, n in y.items() if s not in common)
    times = Counter((x[s], y[s]) for s in common)
    return _similarity([(a, b, n) for (a, b), n in times.items()], only_x, only_y)


def _similarity(common: Iterable[tuple[int, int, int]], only_x: int, only_y: int) -> float:
    """The same from weights in both texts, with how many elements have them, and the weight of the elements in one."""
    common = sorted(common, key=lambda c: c[1] / c[0])
    below, above, out = only_x, only_y + sum(y * m for _, y, m in common), 0.0
    if len(common) == 1 and common[0][0] == common[0][1]:
        x, _, m = common[0]
        return m * x / (m * x + only_x + only_y)
    for x, y, m in common:
        below, above = below + x * m, above - y * m
        out += m / (below / x + above / y)
    return out


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Counter] = (b"", Counter())
        for batch in batches:
            keep = []
            columns = (batch[c].to_pylist() for c in ("a", "text_a", "text_b"))
            for a, text_a, text_b in zip(*columns):
                if last[0] != a:
                    last = (a, shingles(text_a))
                keep.append(probability_jaccard(last[1], shingles(text_b)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough. A node with many pairs is split, on either side."""
    with_a = salted_join(pairs, texts.toDF("a", "text_a"), ["a"], rows_per_salt=ROWS_PER_SALT)
    hot = hot_keys(pairs, ["b"], ROWS_PER_SALT)
    with_both = salted_join(with_a, texts.toDF("b", "text_b"), ["b"], hot=hot).select("a", "b", "text_a", "text_b")
    return with_both.mapInArrow(_verified(similarity), "a binary, b binary")


# --- families ---


def shingle_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of each text's different shingles in order, and how often they occur; a shorter text is one shingle."""
    words, begins = word_values(texts)
    grams = window_hashes(words, SHINGLE)
    edges = begins.tolist()
    for i, j in zip(edges, edges[1:]):
        own = grams[i : j - SHINGLE + 1] if j - i >= SHINGLE else window_hashes(words[i:j], j - i)[: 1 if j > i else 0]
        yield np.unique(own, return_counts=True)


ANSWERS = "a binary, b binary, weight_a long, weight_b long, similarity double, elements binary, before binary, after binary"


def _answer(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Weights of two texts, their similarity, and the elements whose counts differ with both counts."""
    elements, inverse = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    n_x, n_y = np.zeros(len(elements), np.int64), np.zeros(len(elements), np.int64)
    n_x[inverse[: len(x[0])]], n_y[inverse[len(x[0]) :]] = x[1], y[1]
    both = (n_x > 0) & (n_y > 0)
    common, times = np.unique(np.stack([n_x[both], n_y[both]]), axis=1, return_counts=True)
    only_x, only_y = int(n_x[~both].sum()), int(n_y[~both].sum())
    similarity = _similarity(zip(*common.tolist(), times.tolist()), only_x, only_y) if both.any() else 0.0
    other = n_x != n_y
    return int(n_x.sum()), int(n_y.sum()), similarity, elements[other], n_x[other], n_y[other]


def _answers(family: float):
    """Of rows ``a, b, text`` in the order of ``a``, the central text (without ``b``) first."""
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            for part in parts(batch["text"], PART_BYTES):
                rows, out = batch.slice(part.start, part.stop - part.start), []
                counts = shingle_counts(rows["text"])
                for a, b, own in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), counts):
                    if b is None:
                        at, centre = a, own
                        continue
                    if at != a:
                        raise ValueError("a central text is missing")
                    w_a, w_b, similarity, *differing = _answer(centre, own)
                    packed = [d.tobytes() for d in differing] if similarity >= family else [None] * 3
                    out.append((a, b, w_a, w_b, similarity, *packed))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    return run


def central_answers(pairs: DataFrame, texts: DataFrame, family: float = FAMILY) -> DataFrame:
    """``ANSWERS`` of pairs of a central node ``a`` and another one ``b``.

    A pair sends one text; the central one is sent once, or once to each part
    of the pairs where there are many.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(hot_from_counts(counts, ["a"], "_rows", ROWS_PER_SALT))
    salts = F.coalesce("_salts", F.lit(1))
    members = pairs.join(texts.toDF("b", "text"), "b").join(hot, "a", "left")
    members = members.select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("_salt"), "b", "text")
    centres = counts.select("a").join(texts.toDF("a", "text"), "a").join(hot, "a", "left").select(
        "a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), F.lit(None).cast("binary").alias("b"), "text"
    )
    together = members.unionByName(centres).repartition("a", "_salt").sortWithinPartitions("a", "_salt", "b")
    return together.mapInArrow(_answers(family), ANSWERS)


def _derived(similarity: float):
    """Of one pair of blocks of a family: links between members of different classes.

    A link makes the two classes one for what follows, so there are fewer links than classes.
    """

    def run(key, table):  # without hints, from which Spark would guess the kind of function
        nodes = table["node"].to_pylist()
        different, label = np.unique(np.array(table["class"].to_pylist(), object), return_inverse=True)
        home = next(iter(np.flatnonzero(different == table["home"][0].as_py())), -1)  # may be in other blocks
        block, weight = table["block"].to_numpy(), table["weight"].to_numpy()
        centre = int(table["centre"][0].as_py())
        elements, before, after = (
            [np.frombuffer(d or b"", kind) for d in table[c].to_pylist()]
            for c, kind in (("elements", np.uint64), ("before", np.int64), ("after", np.int64))
        )
        length = np.array([len(e) for e in elements])
        edges = np.concatenate([[0], np.cumsum(length)])
        x, y = np.concatenate(before), np.concatenate(after)
        change = y - x
        owner = np.repeat(np.arange(len(nodes)), length)
        total = np.bincount(owner, np.abs(change), len(nodes))
        # weight that may differ between two members that both have the element
        shared_weight = np.bincount(owner, np.where((y > 0) & ((x > 0) | (y > 1)), y, 0), len(nodes))
        number = np.unique(np.concatenate(elements), return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        begins = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
        first, second = key[1].as_py(), key[2].as_py()
        a, b = [], []
        for k in np.flatnonzero(label != home).tolist():
            if block[k] not in (first, second):
                continue
            there = second if block[k] == first else first
            # elements that both have changed in the same direction are no difference as far as both have
            reduced = np.zeros(len(nodes))
            mine = range(edges[k], edges[k + 1])
            if len(mine):
                held = [order[begins[e] : begins[e + 1]] for e in number[mine.start : mine.stop].tolist()]
                own = np.repeat(change[mine.start : mine.stop], [len(h) for h in held])
                held = np.concatenate(held)
                least = np.where(own * change[held] > 0, 2 * np.minimum(np.abs(own), np.abs(change[held])), 0)
                reduced = np.bincount(owner[held], least, len(nodes))
            apart = total[k] + total - reduced
            union = np.maximum((weight[k] + weight + apart) / 2, 1)
            at_most = (weight[k] + weight - apart) / 2 / union
            at_most += (shared_weight[k] + shared_weight) / np.maximum(np.minimum(weight[k], weight), 1)
            likely = (at_most >= similarity - 1e-9) & (label != label[k]) & (block == there)
            for j in np.flatnonzero(likely).tolist():
                if label[j] != label[k] and _between(centre, (elements, before, after), k, j) >= similarity:
                    label[label == label[j]] = label[k]
                    a.append(min(nodes[k], nodes[j]))
                    b.append(max(nodes[k], nodes[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _between(centre: int, table: tuple[list, list, list], j: int, k: int) -> float:
    """Similarity of two members of a family whose central text has the weight ``centre``."""
    changed: dict[int, list[int]] = {}
    for side, m in enumerate((j, k)):
        for e, x, y in zip(*(c[m].tolist() for c in table)):
            changed.setdefault(e, [x, x, x])[1 + side] = y
    same = centre - sum(x for x, _, _ in changed.values())
    common = [(y, z, 1) for _, y, z in changed.values() if y and z]
    same += sum(y for y, z, _ in common if y == z)
    common = [c for c in common if c[0] != c[1]]
    only_y, only_z = (sum(c[s] for c in changed.values() if not c[3 - s]) for s in (1, 2))
    # elements of equal weight in both count like a single one of all their weight
    return _similarity(common + ([(same, same, 1)] if same else []), only_y, only_z)


def derived_links(families: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links inside families that join classes.

    ``families`` are ``ANSWERS`` with differences. Members in the class of
    their central text need no answers of their own; each other one is compared
    with its whole family, large ones in pairs of blocks.
    """
    columns = ["elements", "before", "after"]
    members = families.select(F.col("a").alias("family"), F.col("b").alias("node"), F.col("weight_b").alias("weight"), *columns)
    none = [F.lit(None).cast("binary").alias(c) for c in columns]
    centres = families.groupBy("a").agg(F.first("weight_a").alias("weight")).select(
        F.col("a").alias("family"), F.col("a").alias("node"), "weight", *none
    )
    rows = cut_lineage(
        members.unionByName(centres).join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    )
    is_centre = F.col("node") == F.col("family")
    shapes = rows.groupBy("family").agg(
        F.max(F.when(is_centre, F.col("class"))).alias("home"), F.max(F.when(is_centre, F.col("weight"))).alias("centre"),
        F.min("class").alias("_low"), F.max("class").alias("_high"), F.count(F.lit(1)).alias("_rows"),
    )
    mixed = cut_lineage(shapes.where("_low <> _high").select("family", "home", "centre", "_rows"))
    placed = (
        salted_join(rows, mixed, ["family"], hot=hot_from_counts(mixed, ["family"], "_rows", ROWS_PER_SALT))
        .withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("first", F.least("block", "_other"))
        .withColumn("second", F.greatest("block", "_other"))
        .drop("_rows", "_blocks", "_other")
    )
    return placed.groupBy("family", "first", "second").applyInArrow(_derived(similarity), "a binary, b binary")


# --- proposals ---


def central_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``a, b``: each member ``b`` with the most central node ``a`` of its buckets, and with the one that this leads to.

    Central is who lies in large buckets: near copies change some bands of what
    they are copied from, so the original has the most common ones. A central
    node may have a more central one in its own buckets, and so on.
    """
    # a node lies in at most as many buckets as there are bands
    scored = members.withColumn("score", F.sum("size").over(Window.partitionBy("node")))
    ranked = scored.groupBy("bucket").agg(
        F.max(F.struct("score", "node")).alias("best"), F.first("size").alias("size")
    )
    total = members.count()
    keyed = members.select(F.col("node").alias("b"), F.col("bucket").cast("string").cast("binary").alias("key"))
    facts = ranked.select(F.col("bucket").cast("string").cast("binary").alias("key"), "best", "size")
    told = join_facts(keyed, facts, "key", "size", total)
    direct = cut_lineage(told.groupBy("b").agg(F.max("best")["node"].alias("a")).where("a <> b").select("a", "b"))
    leads = direct
    for _ in range(JUMPS):
        further = direct.select(F.col("b").alias("a"), F.col("a").alias("_next"))
        leads = salted_join(leads, further, ["a"], "left").select(F.coalesce("_next", "a").alias("a"), "b")
    return direct.unionByName(leads.where("a <> b")).distinct()


def least_agreeing(similarity: float) -> int:
    """In fewer components than this a pair of the similarity agrees with a probability of at most ``LEFT_OUT``."""
    each = similarity + (1 - similarity) / 256  # bytes also agree by chance
    fewer = 0.0
    for n in range(COMPONENTS):
        fewer += comb(COMPONENTS, n) * each**n * (1 - each) ** (COMPONENTS - n)
        if fewer > LEFT_OUT:
            return n
    return COMPONENTS


def _propose(partners: int, least: int):
    """Of one pair of blocks of a bucket: members outside the largest class and their likeliest partners.

    A pair is proposed in the bucket of the first band that it agrees in, and
    nowhere else; ``before`` has a member's buckets of the bands before this
    one, as the sketch's bytes also agree by chance. ``more`` says that a
    member has further partners.
    """

    def run(key, table):  # without hints, from which Spark would guess the kind of function
        nodes = table["node"].to_pylist()
        label = np.unique(np.array([c or n for c, n in zip(table["class"].to_pylist(), nodes)], object), return_inverse=True)[1]
        block = table["block"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(nodes), COMPONENTS)
        families = table["family"].to_pylist()
        own = {n: k for k, n in enumerate(dict.fromkeys(nodes + families))}
        node_at, family = (np.array([own[n] for n in x]) for x in (nodes, families))
        before = table["before"].combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        largest = np.bincount(label).argmax()
        pairs, more = set(), False
        first, second = key[2].as_py(), key[3].as_py()
        for k in np.flatnonzero(label != largest).tolist():
            here, there = block[k], None
            if here not in (first, second):
                continue
            there = second if here == first else first
            kin = (family == family[k]) | (family == node_at[k]) | (node_at == family[k])
            others = np.flatnonzero((label != label[k]) & (block == there) & ~kin)
            if not len(others):
                continue
            agreeing = (sketch[others] == sketch[k]).sum(axis=1)
            met = (before[others] == before[k]).any(axis=1)
            chosen = np.flatnonzero((agreeing >= least) & ~met)
            if len(chosen) > partners:
                more = True
                chosen = chosen[np.argsort(-agreeing[chosen], kind="stable")[:partners]]
            likely = others[chosen]
            pairs.update((min(nodes[k], nodes[j]), max(nodes[k], nodes[j])) for j in likely.tolist())
        a, b = zip(*sorted(pairs)) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "more": pa.array([more] * len(a), pa.bool_())})

    return run


def open_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, with their present class, of the buckets that hold several classes and families."""
    labelled = (
        members.drop("class")
        .join(classes, "node", "left")
        .withColumn("class", F.coalesce("class", "node"))
        .select("bucket", "band", "size", "node", "class", "family")
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(*(f(c).alias(n + c) for c in ("class", "family") for f, n in ((F.min, "low_"), (F.max, "high_"))))
        .where("low_class <> high_class AND low_family <> high_family")
        .select("bucket")
    )
    return cut_lineage(labelled.join(mixed, "bucket", "left_semi"))


def proposed_pairs(
    members: DataFrame, sketches: DataFrame, partners: int, similarity: float = SIMILARITY
) -> DataFrame:
    """Likely pairs ``a < b`` between different classes of a bucket, and whether their bucket has ``more``.

    Pairs of the same ``family``, if members have one, are left out: all of its links are known.
    """
    if "family" not in members.columns:
        members = members.withColumn("family", F.col("node"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # a member of block i meets block j in the group (i, j) or (j, i)
    placed = (
        members.join(sketches, "node")
        .withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("first", F.least("block", "_other"))
        .withColumn("second", F.greatest("block", "_other"))
        .withColumn("before", F.slice("bands", F.lit(1), F.col("band")))
        .select("bucket", "band", "first", "second", "block", "node", "class", "family", "sketch", "before")
    )
    groups = placed.groupBy("bucket", "band", "first", "second")
    found = groups.applyInArrow(_propose(partners, least_agreeing(similarity)), "a binary, b binary, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def near_links(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``node, class`` of the nodes that are linked to another."""
    in_buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = cut_lineage(in_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # most buckets hold one node, and their rows need not be sent
    members = cut_lineage(possible(in_buckets, sizes, "bucket").join(sizes, "bucket"))
    sketches = nodes.select("node", "bands", "sketch")
    involved = cut_lineage(members.select("node").distinct())
    texts = cut_lineage(needed_texts(rows, involved, "node"))

    tried = cut_lineage(central_pairs(members, sizes))
    answers = cut_lineage(central_answers(tried, texts))
    links = answers.where(F.col("similarity") >= similarity).select("a", "b")
    labels = connected_components(links)
    # a node's family is the largest one among those of its central nodes that are similar enough
    near = answers.where("elements IS NOT NULL")
    kin = cut_lineage(near.select("a", "b"))
    largest = salted_join(kin, kin.groupBy("a").agg(F.count(F.lit(1)).alias("_kin")), ["a"], rows_per_salt=ROWS_PER_SALT)
    chosen = largest.groupBy("b").agg(F.max(F.struct("_kin", "a"))["a"].alias("a"))
    families = cut_lineage(near.join(chosen, ["a", "b"], "left_semi"))
    links = cut_lineage(links.unionByName(derived_links(families, labels, similarity)))
    labels = connected_components(links)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kin = families.select(F.col("b").alias("node"), F.col("a").alias("family"))
    # a central node counts to its own family; its pair with its own central node has been tried
    own = families.select(F.col("a").alias("node")).distinct().withColumn("_own", F.lit(True))
    family = F.when(F.col("_own"), F.col("node")).otherwise(F.col("family")).alias("family")
    members = members.join(kin.join(own, "node", "full").select("node", family), "node", "left")
    members = cut_lineage(members.withColumn("family", F.coalesce("family", "node")))
    # the pair of a bucket of two has been tried only where one of them is central to the other
    pair = members.where("size = 2").groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    known = pair.join(tried, ["a", "b"], "left_semi").select("bucket")
    left = open_members(members.join(known, "bucket", "left_anti"), labels)
    partners = PARTNERS
    while not left.isEmpty():
        proposed = cut_lineage(proposed_pairs(left, sketches, partners, similarity))
        fresh = cut_lineage(proposed.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        more = cut_lineage(verified(fresh, texts, similarity))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = connected_components(links)
        if proposed.where("more").isEmpty():  # every likely pair has been verified
            break
        tried, partners = tried.unionByName(fresh), partners * MORE_PARTNERS
        left = open_members(left, labels)
    return labels


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, carry: bool = False) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row of ``docs``.

    Documents are linked if the probability Jaccard similarity of their
    five-word shingles is at least ``similarity``; a class is what links
    connect. ``class_id`` is the smallest doc_id of the class (nulls last),
    and the row that has it is kept; of several such rows, any one. Equal texts
    are always in one class, also null and empty ones; other texts without
    words are linked to nothing. A text of fewer than five words is one
    shingle. An empty table stays empty. With ``carry`` there is also
    ``_row``, the row as it was.
    """
    text = whole_text(F.col("text"))
    keyed = docs.select(
        *([F.struct("*").alias("_row")] if carry else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("node"),
        text.alias("_text"),
    )
    rows = keyed.select("doc_id", "node", "_text")
    sketched = cut_lineage(rows.mapInArrow(_sketches, SKETCH))
    shape = sketched.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    ids = sketched.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("m")))
    owners = ids.groupBy("node").agg(F.sum("m").alias("n"), best.alias("best"))
    nodes = cut_lineage(shape.join(owners, "node"))

    labels = near_links(rows, nodes, similarity)
    in_class = cut_lineage(
        nodes.select("node", "n", "best")
        .join(labels, "node", "left")
        .withColumn("class", F.coalesce("class", "node"))
    )
    first = F.struct("best.none", "best.id")
    classes = in_class.groupBy("class").agg(F.sum("n").alias("class_size"), F.min(first).alias("first"))
    told = in_class.join(classes, "class")
    n_best = F.sum(F.when(F.struct("best.none", "best.id") == F.col("first"), F.col("best.m")).otherwise(0))
    n_best = told.groupBy("class").agg(n_best.alias("n_best"))
    facts = told.where("class_size > 1").join(n_best, "class")
    facts = cut_lineage(facts.select("node", "n", "class", "class_size", F.col("first.id").alias("class_id"), "n_best"))
    totals = facts.agg(F.sum("n").alias("rows"), F.max("n_best").alias("repeated")).first()
    # rows that are a class of their own need no join and stay where they are
    some, alone = among(keyed.drop("_text"), facts, "node")
    found = join_facts(some, facts, "node", "n", totals["rows"] or 0)
    size, own = F.coalesce("class_size", F.lit(1).cast("long")), F.when(F.col("class_size").isNull(), F.col("doc_id"))
    found = found.withColumns({"class_size": size, "class_id": own.otherwise(F.col("class_id"))})
    found = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    if (totals["repeated"] or 1) > 1:  # some rows tie for the smallest id
        apart = F.concat(F.col("node"), F.monotonically_increasing_id().cast("string").cast("binary"))
        tied = F.col("kept") & (F.col("n_best") > 1)
        found = found.withColumn("_tie", F.when(tied, F.col("class")).otherwise(apart))
        place = F.row_number().over(Window.partitionBy("_tie", "kept").orderBy("node"))
        found = found.withColumn("kept", F.col("kept") & (place == 1)).drop("_tie")
    columns = [*(["_row"] if carry else []), "doc_id", "class_id", "class_size", "kept"]
    alone = alone.withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return found.select(*columns).unionByName(alone.select(*columns))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with its columns."""
    return near_copies(docs, similarity, carry=True).where("kept").select("_row.*")
