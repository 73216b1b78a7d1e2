"""Nearest-neighbour retrieval over embeddings and the context built from it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.functions.strings import col, let

from corpusloom.session import cut_lineage

from .skew import first_rows, salted_join

# Queries are sent to every task up to this many rows and this many bytes.
# More are handled by blocks instead.
MAX_BROADCAST_QUERIES = 4_096
MAX_BROADCAST_BYTES = 64 << 20

# One side of a block pair has at most so many rows and bytes. Every vector is sent to as many
# block pairs as there are blocks on the other side, so blocks are as large as a task can hold
# once there are enough of them to share out the work.
BLOCK_ROWS = 65_536
BLOCK_BYTES = 64 << 20
LEAST_BLOCK_ROWS = 1_024
ENOUGH_BLOCKS = 8

# Pivots that documents are sorted to: the square root of their number, between these bounds.
# All pivots together are sent to every task and stay under MAX_BROADCAST_BYTES.
MIN_PIVOTS, MAX_PIVOTS = 64, 8_192

# Size of one distance matrix and of one exact re-check, queries of one matrix, and documents of the first one.
_MATRIX_CELLS = 2_000_000
_MATRIX_QUERIES = 1_024
_EXACT_PAIRS = 100_000
_FIRST_ROWS = 256

# Squared norms from here on are not multiplied in single precision.
_SINGLE_NORM = 1e30


def clean_vectors(df: DataFrame, vector: str = "embedding", dimension: int = vectors.DEFAULT_DIMENSION, strict: bool = False) -> DataFrame:
    """Drop wrong-width and all-zero vectors; ``strict`` stops on a wrong width."""
    if strict:
        df = df.withColumn(vector, vectors.require_dimension(vector, dimension))
    return df.where(vectors.has_dimension(vector, dimension) & ~vectors.is_zero(vector))


def vector_counts(df: DataFrame, vector: str = "embedding", dimension: int = vectors.DEFAULT_DIMENSION) -> DataFrame:
    """Added, skipped and all-zero vectors."""
    width, zero = vectors.has_dimension(vector, dimension), vectors.is_zero(vector)
    return df.agg(
        F.count_if(width & ~zero).alias("added"),
        F.count_if(~(width & ~zero)).alias("skipped"),
        F.count_if(zero).alias("zero_vectors"),
    )


def matches_filters(meta: Column | str, filters: dict[str, object]) -> Column:
    """All given metadata keys equal the given values, compared as text."""
    meta = col(meta)
    keep = F.lit(True)
    for key, value in filters.items():
        keep = keep & (F.try_element_at(meta, F.lit(key)) == F.lit(str(value)))
    return F.coalesce(keep, F.lit(False))


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.vstack(vecs.to_numpy()).astype(np.float64)


class _TopK:
    """The k nearest documents per query among the rows seen so far.

    A matrix product in single precision finds the rows that can be among the
    k nearest; its rounding error is covered by a margin. Where many rows are
    inside that margin, or numbers are too large for it, it is done in double
    precision. Those rows get their exact distance, and ties go to the smaller id.
    """

    def __init__(self, queries: np.ndarray, keys: np.ndarray | None, k: int) -> None:
        self.q, self.keys, self.k = queries, keys, k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.sides = {np.float64: np.hstack([-2.0 * queries, np.ones((len(queries), 1))])}
        # numbers that do not fit leave the product, see _product
        with np.errstate(over="ignore"):
            self.sides[np.float32] = self.sides[np.float64].astype(np.float32)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.limit = np.full(len(queries), np.inf)

    @property
    def best(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("q", "doc_id", "d2"), self.found)))

    def add(self, ids: np.ndarray, vecs: np.ndarray, keys: np.ndarray | None, barred=None) -> None:
        """``barred``: of a slice of the rows, which queries (by row) must not meet which of them."""
        most = max(1, _MATRIX_CELLS // max(1, len(self.q)))
        at, step = 0, min(most, max(_FIRST_ROWS, 2 * self.k))
        while at < len(ids):
            part = slice(at, at + step)
            no = None if barred is None else barred(part)
            if keys is not None:
                other = self.keys[:, None] != keys[part][None, :]
                no = other if no is None else no | other
            self._merge(self._scan(ids[part], vecs[part], no))
            at, step = at + step, min(most, 4 * step)

    def _merge(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Keep k rows per query after every step, so many equal vectors never pile up."""
        if not len(found[0]):
            return
        q, ids, d2 = (np.concatenate([a, b]) for a, b in zip(self.found, found)) if len(self.found[0]) else found
        if ids.dtype == object:
            order = pd.DataFrame({"q": q, "d2": d2, "ids": ids}).sort_values(["q", "d2", "ids"], kind="stable").index.to_numpy()
        else:
            order = np.lexsort((ids, d2, q))
        q = q[order]
        begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.append(begins, len(q)))
        kept = np.arange(len(q)) - np.repeat(begins, sizes) < self.k
        self.found = (q[kept], ids[order[kept]], d2[order[kept]])
        full = begins[sizes >= self.k]
        self.limit[q[full]] = d2[order[full + self.k - 1]]

    def _scan(self, ids: np.ndarray, x: np.ndarray, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = np.einsum("ij,ij->i", x, x)
        near = None
        if max(self.norms.max(initial=0.0), norms.max(initial=0.0)) < _SINGLE_NORM:
            near = self._near(x, norms, barred, np.float32)
        if near is None or len(near) > self.q.shape[0] * len(x) // 8:
            near = self._near(x, norms, barred, np.float64)
        qi, xi = np.divmod(near, max(1, len(x)))
        exact = np.empty(len(qi))
        for at in range(0, len(qi), _EXACT_PAIRS):
            part = slice(at, at + _EXACT_PAIRS)
            diff = self.q[qi[part]] - x[xi[part]]
            exact[part] = np.einsum("ij,ij->i", diff, diff)
        return qi, ids[xi], exact

    def _near(self, x: np.ndarray, norms: np.ndarray, barred: np.ndarray | None, kind: type) -> np.ndarray:
        """Cells (query by document) that can be hits: squared distances less the query's norm, with the error of ``kind``."""
        d2 = self.sides[kind] @ np.hstack([x, norms[:, None]]).astype(kind).T
        far = norms.max(initial=0.0)
        # of a sum of products, each of them rounded, and of the norms before
        unit = (x.shape[1] + 8) * np.finfo(kind).eps
        margin = unit * (2.0 * np.sqrt(self.norms * far) + far + self.norms) + 1e-30 * (1.0 + self.norms + far)
        if kind is np.float64:
            margin = np.maximum(margin, 1e-9 * (1.0 + self.norms + far))
        if barred is not None:
            d2[barred] = np.inf
        kth = self.limit - self.norms
        # once a query has k rows, few others pass, so only the first ones are ranked here
        new = np.flatnonzero(np.isinf(kth))
        if len(x) > self.k and len(new):
            kth[new] = np.partition(d2[new], self.k - 1, axis=1)[:, self.k - 1]
        # rounded up, so that a limit in single precision is not below the one it stands for
        limit = np.nextafter((kth + 2.0 * margin).astype(kind), kind(np.inf))
        near = d2 <= limit[:, None]
        if np.isinf(limit).any():
            near &= np.isfinite(d2)
        return np.flatnonzero(near)


def _nearest(queries: DataFrame, docs: DataFrame, k: int, max_broadcast: int, block_rows: int | None = None) -> DataFrame:
    """``query_id, doc_id, d2``: per query the k nearest of each task, unmerged.

    Both sides have an id, a ``vec`` and, when filtering, a ``key``.
    """
    keyed = "key" in docs.columns
    width = docs.select(F.size("vec")).first()
    row_bytes = 8 * (width[0] if width else 1)
    most = max(1, min(max_broadcast, MAX_BROADCAST_BYTES // max(1, row_bytes)))
    head = queries.limit(most + 1).toPandas()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    fields = f"query_id {query_type}, doc_id {id_type}, d2 double"
    if len(head) <= most:
        return _nearest_broadcast(head, docs, k, keyed, fields)
    least, most = block_rows or LEAST_BLOCK_ROWS, max(1, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes))
    if keyed:
        return _nearest_by_key(queries, docs, k, fields, least, most)
    return _nearest_by_cell(queries, docs, k, fields, least, most, MAX_BROADCAST_BYTES // row_bytes)


def _nearest_broadcast(
    head: pd.DataFrame, docs: DataFrame, k: int, keyed: bool, fields: str
) -> DataFrame:
    """Few queries: every task holds them all and scans its own documents once."""
    if head.empty:
        return docs.sparkSession.createDataFrame([], fields)
    shared = docs.sparkSession.sparkContext.broadcast(
        (head["query_id"].to_numpy(), _matrix(head["vec"]), head["key"].to_numpy() if keyed else None)
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix, keys = shared.value
        top = _TopK(matrix, keys, k)
        for batch in batches:
            if len(batch):
                top.add(
                    batch["doc_id"].to_numpy(),
                    _matrix(batch["vec"]),
                    batch["key"].to_numpy() if keyed else None,
                )
        best = top.best
        yield pd.DataFrame(
            {
                "query_id": query_ids[best["q"].to_numpy(dtype=int)],
                "doc_id": best["doc_id"].to_numpy(),
                "d2": best["d2"].to_numpy(),
            }
        )

    return docs.mapInPandas(scan, fields)


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different vector, and which of these each row is."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    return np.unique(rows, return_index=True, return_inverse=True)[1:]


def _rows_of(vecs: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one width as a matrix."""
    if pc.count_distinct(pc.list_value_length(vecs), mode="all").as_py() > 1:
        raise ValueError("vectors differ in width")
    flat = pc.list_flatten(vecs).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vecs), -1)


def _pair(q: pa.Table, d: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest documents of one block for the queries of another: rows of both and ``d2``.

    Equal queries are looked up once, and of equal documents the k smallest ids can be hits.
    """
    order = pc.sort_indices(d["doc_id"]).to_numpy()
    x = _rows_of(d["vec"])[order]
    same = pd.Series(_different(x)[1])
    few = np.flatnonzero((same.groupby(same).cumcount() < k).to_numpy())
    x = x[few].astype(np.float64)
    y = _rows_of(q["vec"])
    first, which = _different(y)
    found = []
    for at in range(0, len(first), _MATRIX_QUERIES):
        top = _TopK(y[first[at : at + _MATRIX_QUERIES]].astype(np.float64), None, k)
        top.add(few, x, None)
        own, row, d2 = top.found
        found.append((own + at, row, d2))
    own, row, d2 = (np.concatenate(part) for part in zip(*found))
    # hits of each different query are together and in order of the queries
    begins = np.searchsorted(own, np.arange(len(first) + 1))
    sizes = np.diff(begins)[which]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins[which], sizes)
    return np.repeat(np.arange(len(which)), sizes), order[row[at].astype(np.int64)], d2[at]


def _pair_up(left: DataFrame, right: DataFrame, group: list[str], k: int, fields: str) -> DataFrame:
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        qi, di, d2 = _pair(q, d, k) if len(q) and len(d) else (none, none, np.zeros(0))
        return pa.table({"query_id": q["query_id"].take(pa.array(qi)), "doc_id": d["doc_id"].take(pa.array(di)), "d2": d2})

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, fields)


def _block_rows(n: Column, least: int, most: int) -> Column:
    """Rows of a block where there are ``n``: ``ENOUGH_BLOCKS`` blocks if these are not too small or too large."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n / ENOUGH_BLOCKS)))


def _nearest_by_key(queries: DataFrame, docs: DataFrame, k: int, fields: str, least: int, most: int) -> DataFrame:
    """Many queries with a filter key: blocks of bounded size inside each key.

    Each pair of a query block and a document block of a key is one small
    group, which returns only the k nearest of each query. A key with a third
    of all rows becomes many blocks instead of one large group.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy("key").agg(F.ceil(n / _block_rows(n, least, most)).cast("int").alias(name))

    sizes = blocks(queries, "q_blocks").join(blocks(docs, "d_blocks"), "key")

    def place(df: DataFrame, id_name: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        # one small row per key against many rows of that key
        return salted_join(df, sizes, ["key"]).select(
            "key",
            id_name,
            "vec",
            F.pmod(F.xxhash64(id_name), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
        )

    left = place(queries, "query_id", "q_blocks", "d_blocks", "qb", "db")
    right = place(docs, "doc_id", "d_blocks", "q_blocks", "db", "qb")
    return _pair_up(left, right, ["key", "qb", "db"], k, fields)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _packed(counts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: cells that follow each other share one while they fit."""
    rows = min(most, max(least, -(-int(counts.sum()) // ENOUGH_BLOCKS)))
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, held = 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > rows:
            block, held = block + 1, 0
        first[c], parts[c], held = block, max(1, -(-n // rows)), held + n
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
    return first, parts


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest one left."""
    left, order = np.ones(len(pivots), bool), [0]
    for _ in range(len(pivots) - 1):
        left[order[-1]] = False
        rest = np.flatnonzero(left)
        order.append(int(rest[_distances(pivots[order[-1]][None, :], pivots[rest])[0].argmin()]))
    return np.array(order)


def _nearest_by_cell(
    queries: DataFrame, docs: DataFrame, k: int, fields: str, least: int, most: int, pivots_that_fit: int
) -> DataFrame:
    """Many queries: documents in cells around pivots, and only cells that can matter.

    Every document belongs to its nearest pivot. The number of documents and
    the radius of each cell bound the distance of a query's k-th neighbour
    from above; the triangle inequality bounds the distance to any document
    of a cell from below. A query visits the cells whose lower bound does not
    pass its upper bound, so the result is exact. Near cells share a block of
    bounded size and large ones are cut into several, so a query is sent to
    each block once, however many cells of it matter. Queries are in blocks by
    their own nearest pivots. Documents and queries with their cells are each
    computed once and written.
    """
    spark = docs.sparkSession
    n_pivots = max(1, min(max(MIN_PIVOTS, round(docs.count() ** 0.5)), MAX_PIVOTS, pivots_that_fit))
    sample = docs.orderBy(F.xxhash64("doc_id")).limit(n_pivots).select("vec").toPandas()
    if sample.empty:
        return spark.createDataFrame([], fields)
    around = _matrix(sample["vec"])
    pivots = spark.sparkContext.broadcast(around[_chain(around)])  # cells are numbered in this order
    id_type = docs.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    vec_type = docs.schema["vec"].dataType.simpleString()
    query_vec_type = queries.schema["vec"].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        step = max(1, _MATRIX_CELLS // len(pivots.value))
        for batch in batches:
            for at in range(0, len(batch), step):
                piece = batch.iloc[at : at + step]
                yield piece, _distances(_matrix(piece["vec"]), pivots.value)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, far in pieces(batches):
            cell = far.argmin(axis=1)
            yield piece.assign(cell=cell.astype(np.int32), radius=far[np.arange(len(far)), cell])

    placed = cut_lineage(
        docs.select("doc_id", "vec").mapInPandas(assign, f"doc_id {id_type}, vec {vec_type}, cell int, radius double")
    )
    asking = cut_lineage(
        queries.select("query_id", "vec").mapInPandas(
            assign, f"query_id {query_type}, vec {query_vec_type}, cell int, radius double"
        )
    )
    # at most one row per pivot
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")
    ).toPandas().sort_values("cell")
    asked = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("cell")
    cells["first"], cells["parts"] = _packed(cells["n"].to_numpy(), least, most)
    asked["first"], asked["parts"] = _packed(asked["n"].to_numpy(), least, most)
    known = spark.sparkContext.broadcast(cells)
    query_blocks = int((asked["first"] + asked["parts"]).max()) if len(asked) else 1

    def blocks(df: pd.DataFrame) -> DataFrame:
        rows = [tuple(map(int, r)) for r in df[["cell", "first", "parts"]].to_numpy()]
        return F.broadcast(spark.createDataFrame(rows, "cell int, _first int, _parts int"))

    def block_of(id_name: str) -> Column:
        return (F.col("_first") + F.pmod(F.xxhash64(id_name), F.col("_parts"))).cast("int")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and block that it visits, and at last one for each query block and cell."""
        c = known.value
        n, near, far, cell = (c[x].to_numpy() for x in ("n", "near", "far", "cell"))
        first, parts = c["first"].to_numpy(), c["parts"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        visited = np.zeros((query_blocks, len(c)), bool)
        for piece, d in pieces(batches):
            d = d[:, cell]
            within = d + far
            order = np.argsort(within, axis=1)
            reached = np.cumsum(n[order], axis=1) >= k
            # fewer than k documents in all: every cell is needed
            at = np.where(reached.any(axis=1), reached.argmax(axis=1), d.shape[1] - 1)
            limit = within[np.arange(len(d)), order[np.arange(len(d)), at]]
            limit[~reached.any(axis=1)] = np.inf
            needed = np.maximum(d - far, near - d) <= (limit * (1 + 1e-9) + 1e-6)[:, None]
            for qb in np.unique(piece["qb"]):
                visited[qb] |= needed[(piece["qb"] == qb).to_numpy()].any(axis=0)
            qi, bi = np.nonzero(np.logical_or.reduceat(needed, begins, axis=1))
            several = parts[begins][bi]
            qi, db = np.repeat(qi, several), np.repeat(first[begins][bi], several)
            db += np.arange(len(db)) - np.repeat(np.cumsum(several) - several, several)
            for some in range(0, len(qi), BLOCK_ROWS):
                picked = piece.iloc[qi[some : some + BLOCK_ROWS]]
                yield picked[["query_id", "vec", "qb"]].assign(db=db[some : some + BLOCK_ROWS].astype(np.int32), cell=np.int32(-1))
        qb, ci = np.nonzero(visited)
        yield pd.DataFrame({"query_id": None, "vec": None, "qb": qb.astype(np.int32), "db": np.int32(-1), "cell": cell[ci]})

    dealt = asking.join(blocks(asked), "cell").select("query_id", "vec", block_of("query_id").alias("qb"))
    told = cut_lineage(
        dealt.mapInPandas(visit, f"query_id {query_type}, vec {query_vec_type}, qb int, db int, cell int")
    )
    # a document is sent to the query blocks that visit its cell, and to no others
    visited = told.where("db < 0").groupBy("cell").agg(F.collect_set("qb").alias("_qbs"))
    right = placed.join(blocks(cells), "cell").join(F.broadcast(visited), "cell").select(
        "doc_id", "vec", block_of("doc_id").alias("db"), F.explode("_qbs").alias("qb")
    )
    return _pair_up(told.where("db >= 0").select("query_id", "vec", "db", "qb"), right, ["db", "qb"], k, fields)


def nearest(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    metric: str = "l2",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    doc_id: str = "doc_id",
    doc_vector: str = "embedding",
    filter_key: str | None = None,
    mode: str = "pre",
    max_broadcast: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact nearest documents: ``query_id, doc_id, rank, distance, score``.

    With ``filter_key``, a column both sides have, a query only meets
    documents with its own value; null meets nothing. ``mode="pre"`` filters before ranking.
    ``mode="post"`` ranks the nearest 2k first and may return fewer than k.
    More queries than ``max_broadcast`` (by default ``MAX_BROADCAST_QUERIES``)
    are handled by blocks of about ``block_rows`` (by default ``LEAST_BLOCK_ROWS``), or
    an eighth of a side if that is more, up to what ``BLOCK_ROWS`` and
    ``BLOCK_BYTES`` allow; the hits are the same. Hits are ranked in two
    levels, as every task or block pair may return k of a query.
    """
    max_broadcast = MAX_BROADCAST_QUERIES if max_broadcast is None else max_broadcast
    if metric not in vectors.METRICS:
        raise ValueError(f"metric must be one of {vectors.METRICS}")
    if mode not in ("pre", "post"):
        raise ValueError("mode must be pre or post")
    post = filter_key is not None and mode == "post"
    key = [] if filter_key is None or post else [F.col(filter_key).alias("key")]
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vec"), *key)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vector).alias("vec"), *key)
    if key:
        q, d = q.where(F.col("key").isNotNull()), d.where(F.col("key").isNotNull())
    depth = 2 * k if post else k
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "doc_id"))
    hits = first_rows(_nearest(q, d, depth, max_broadcast, block_rows), ["query_id"], ["d2", "doc_id"], depth)
    hits = hits.withColumn("rank", rank)
    if post:
        q_keys = queries.select(F.col(query_id).alias("query_id"), F.col(filter_key).alias("_want"))
        d_keys = docs.select(F.col(doc_id).alias("doc_id"), F.col(filter_key).alias("_has"))
        hits = (
            hits.join(q_keys, "query_id")
            .join(d_keys, "doc_id")
            .where(F.col("_want") == F.col("_has"))
            .withColumn("rank", rank)
            .where(F.col("rank") <= k)
        )
    distance = F.sqrt("d2") if metric == "l2" else F.col("d2")
    return hits.select(
        "query_id", "doc_id", "rank", distance.alias("distance"), (1 / (1 + distance)).alias("score")
    )


def search(
    queries: DataFrame, docs: DataFrame, k: int = 5, filters: dict[str, object] | None = None,
    meta: str = "meta", **options,
) -> DataFrame:
    """``nearest`` with fixed metadata filters, applied before ranking."""
    if filters:
        docs = docs.where(matches_filters(meta, filters))
    return nearest(queries, docs, k, **options)


def related_files(hits: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Hits of a query grouped by file, best file first.

    ``hits`` has ``query_id, rank, score, file_path, content`` and may have
    chunk columns. A group holds at most k hits. Columns named in ``more`` are kept as those of a file's best hit.
    """
    extra = [c for c in ("language", "start_line", "end_line", "is_chunk", "chunk_index", "total_chunks") if c in hits.columns]
    extra += more
    path = F.coalesce("file_path", F.lit("unknown"))
    files = hits.groupBy("query_id", path.alias("file_path")).agg(
        F.max("score").alias("score"),
        F.min("rank").alias("best_rank"),
        *[F.min_by(c, "rank").alias(c) for c in extra],
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda h: h["content"]
        ).alias("contents"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank"))
    return files.withColumn("file_rank", place)


def context_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(
        F.countDistinct(F.coalesce("file_path", F.lit("unknown"))).alias("total_files"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.avg("score").alias("avg_score"),
    )


def context_text(hits: DataFrame, *facts: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """One text per query: its files with their header lines and contents.

    ``facts`` are further aggregates over the rows of ``related_files``, taken in the same pass.
    """
    files = related_files(hits, more)
    have = set(files.columns)
    parts: list[Column] = [F.concat(F.lit("File: "), F.col("file_path"))]
    if "language" in have:
        parts.append(F.concat(F.lit("Language: "), F.col("language")))
    if {"start_line", "end_line"} <= have:
        parts.append(
            F.concat(F.lit("Lines: "), F.col("start_line"), F.lit("-"), F.col("end_line"))
        )
    if {"is_chunk", "chunk_index", "total_chunks"} <= have:
        number = F.concat(
            F.lit("Chunk: "), F.col("chunk_index") + 1, F.lit("/"), F.col("total_chunks")
        )
        parts.append(F.when(F.col("is_chunk"), number))
    # concat_ws leaves out the lines that are null
    block = F.concat_ws("\n", *parts, F.lit("Content:"), F.array_join("contents", "\n"), F.lit("---"))
    return files.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("file_rank", block.alias("block")))),
                lambda f: f["block"],
            ),
            "\n",
        ).alias("context"),
        *facts,
    )


def context_plain(hits: DataFrame) -> DataFrame:
    """The short form: contents in rank order between separator lines."""
    return hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda h: h["content"]
            ),
            "\n---\n",
        ).alias("context")
    )


def hashed_embedding(
    df: DataFrame, text: str = "text", dimension: int = vectors.DEFAULT_DIMENSION, output: str = "embedding"
) -> DataFrame:
    """Deterministic embeddings by feature hashing of words, unit length.

    Stands in for a hosted model, so retrieval works without one. A word
    counts at the place given by the first 32 bits of its MD5. A text without
    words becomes the zero vector.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")

    # as if not deterministic: a filter on the vectors would otherwise make them again for each place that names them
    @F.arrow_udf("array<float>")
    def unit(words: pa.Array) -> pa.Array:
        coded = pc.list_flatten(words).dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        place = np.array([int.from_bytes(hashlib.md5(w).digest()[:4]) % dimension for w in known], np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begins = np.concatenate([[0], ends])
        out = np.empty((len(words), dimension), np.float32)
        step = max(1, min(_MATRIX_QUERIES, _MATRIX_CELLS // max(1, dimension)))
        for at in range(0, len(words), step):
            edges = begins[at : at + step + 1]
            row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            cell = row * dimension + place[codes[edges[0] : edges[-1]]]
            counts = np.bincount(cell, minlength=(len(edges) - 1) * dimension).reshape(-1, dimension)
            squares = np.maximum((counts * counts).sum(axis=1), 1)
            out[at : at + step] = counts / np.sqrt(squares.astype(np.float64))[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dimension), pa.array(out.ravel()))

    return df.withColumn(output, unit.asNondeterministic()(words))


def embed(df: DataFrame, embed_fn, text: str = "text", output: str = "embedding") -> DataFrame:
    """Embeddings from the caller's function of a text column, usually a pandas UDF."""
    from corpusloom.functions.tokens import first_window

    return df.withColumn(output, embed_fn(first_window(text)))
