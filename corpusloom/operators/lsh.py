"""Approximate nearest neighbours by random-projection hash tables.

A table projects a vector on a few directions and cuts each projection into
intervals; near vectors often share all intervals of a table. Documents that
share a bucket with a query in any table are its candidates, and the distances
of candidates are exact. With ``probes``, a query also looks into buckets
next to its own, those whose border is nearest.

The directions come from a formula, so tables need not be stored to be used
again, and every task can make them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

from .retrieval import _MATRIX_QUERIES, _matrix, _TopK
from .skew import first_rows

# A bucket with more documents or queries is handled in pairs of blocks of so many.
BLOCK_ROWS = 16_384

# Fixed values of the formula: odd steps and a prime.
_STEP, _TABLE, _MODULUS = 7919, 104729, 65521


@dataclass(frozen=True)
class Projections:
    """``tables`` hash tables of ``directions`` directions each, in intervals of ``length``."""

    tables: int = 8
    directions: int = 3
    length: float = 1.0

    def matrix(self, width: int) -> np.ndarray:
        """``width x (tables * directions)`` numbers between -1 and 1."""
        j, t = np.arange(width, dtype=np.int64)[:, None], np.arange(self.tables * self.directions, dtype=np.int64)[None, :]
        mixed = ((j + 1) * _STEP + (t + 1) * _TABLE) % _MODULUS
        return ((mixed * mixed + (j + 1) * (t + 1)) % _MODULUS) * 2.0 / (_MODULUS - 1) - 1.0

    def shift(self) -> np.ndarray:
        """Where the intervals of each direction begin, as shares of their length."""
        t = np.arange(self.tables * self.directions)
        return (t * 31 % 17) / 17.0


def fit_length(docs: DataFrame, how: Projections, k: int, vector: str, rows: int = 2_000) -> Projections:
    """Intervals as long as projections of ``k``-th neighbours lie apart, from up to ``rows`` documents."""
    sample = docs.select(vector).orderBy(F.xxhash64(vector)).limit(rows).toPandas()[vector]
    if len(sample) < 2:
        return how
    total = docs.count()
    x = np.vstack(sample.to_numpy()).astype(np.float64)
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
    # of a sample the k-th neighbour in all documents is a nearer one
    near = max(1, min(len(x) - 1, round(k * len(x) / total)))
    distance = np.sqrt(np.maximum(np.partition(d2, near, axis=1)[:, near], 0))
    spread = np.sqrt((how.matrix(x.shape[1]) ** 2).mean())
    return Projections(how.tables, how.directions, float(max(4 * np.median(distance) * spread, 1e-9)))


def _intervals(x: np.ndarray, how: Projections, probes: int) -> list[np.ndarray]:
    """``rows x tables x directions``: the intervals of each vector, and of each probe."""
    at = x @ how.matrix(x.shape[1]) / how.length + how.shift()
    cell = np.floor(at)
    own = cell.reshape(len(x), how.tables, how.directions).astype(np.int64)
    keys = [own]
    if probes:
        inside = (at - cell).reshape(own.shape)
        border = np.concatenate([inside, 1 - inside], axis=2)  # to the interval below, and to the one above
        for nth in np.argsort(border, axis=2, kind="stable")[:, :, :probes].transpose(2, 0, 1):
            other = own.copy()
            k, t = np.indices(nth.shape)
            other[k, t, nth % how.directions] += np.where(nth < how.directions, -1, 1)
            keys.append(other)
    return keys


def bucketed(rows: DataFrame, id_name: str, vector: str, how: Projections, probes: int = 0) -> DataFrame:
    """``id_name, table, bucket``: one row for each vector and table, and for each probed bucket.

    Probes change one interval of a table to its neighbour, nearest borders first.
    """
    id_type = rows.schema[id_name].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vec"])
            for key in _intervals(x, how, probes):
                yield pd.DataFrame(
                    {
                        id_name: np.repeat(batch[id_name].to_numpy(), how.tables),
                        "table": np.tile(np.arange(how.tables), len(x)),
                        "bucket": [",".join(map(str, b)) for b in key.reshape(-1, how.directions).tolist()],
                    }
                )

    picked = rows.select(F.col(id_name), F.col(vector).alias("vec"))
    return picked.mapInPandas(run, f"{id_name} {id_type}, table int, bucket string")


def _codes(keys: list[np.ndarray]) -> np.ndarray:
    """``rows x tables x probes``: 64 bits of a hash of the intervals."""
    out = np.zeros((*keys[0].shape[:2], len(keys)), np.uint64)
    with np.errstate(over="ignore"):
        for p, key in enumerate(keys):
            for d in range(key.shape[2]):
                mixed = (out[:, :, p] ^ key[:, :, d].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(d + 1)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                out[:, :, p] = mixed ^ (mixed >> np.uint64(32))
    return out.view(np.int64)


def _placed(rows: DataFrame, id_name: str, how: Projections, probes: int, whole: bool = True) -> DataFrame:
    """``table, code`` of each vector and bucket, with ``id_name, vec, codes`` (of all its buckets) if ``whole``."""
    id_type, vec_type = (rows.schema[c].dataType.simpleString() for c in (id_name, "vec"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.iloc[at : at + 256]
                codes = _codes(_intervals(_matrix(piece["vec"]), how, probes))
                table = np.repeat(np.tile(np.arange(how.tables, dtype=np.int32), len(piece)), probes + 1)
                out = pd.DataFrame({"table": table, "code": codes.ravel()})
                if whole:
                    row = np.repeat(np.arange(len(piece)), how.tables * (probes + 1))
                    packed = np.array([c.tobytes() for c in codes], object)
                    out = out.assign(**{id_name: piece[id_name].to_numpy()[row], "vec": piece["vec"].to_numpy()[row], "codes": packed[row]})
                yield out

    more = f", {id_name} {id_type}, vec {vec_type}, codes binary" if whole else ""
    return rows.select(id_name, "vec").mapInPandas(run, f"table int, code long{more}")


def _met(k: int, tables: int, probes: int):
    """The nearest documents of a bucket for its queries, and how many each meets here and in no table before."""

    def run(key, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "d2": [], "n": []})
        table = int(key[0])
        y, x, ids = _matrix(q["vec"]), _matrix(d["vec"]), d["doc_id"].to_numpy()
        asked = np.frombuffer(b"".join(q["codes"]), np.int64).reshape(len(q), tables, probes + 1)
        held = np.frombuffer(b"".join(d["codes"]), np.int64).reshape(len(d), tables)
        found = []
        for at in range(0, len(q), _MATRIX_QUERIES):
            mine = slice(at, at + _MATRIX_QUERIES)
            n = np.zeros(len(y[mine]), np.int64)

            def before(part: slice) -> np.ndarray:
                met = np.zeros((len(n), len(ids[part])), bool)
                for t in range(table):
                    for p in range(probes + 1):
                        met |= asked[mine, t, p][:, None] == held[part, t][None, :]
                np.add(n, (~met).sum(axis=1), out=n)
                return met

            top = _TopK(y[mine], None, k)
            top.add(ids, x, None, before)
            best, row = top.best, top.best["q"].to_numpy(dtype=int)
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            found.append(
                pd.DataFrame({"query_id": q["query_id"].to_numpy()[mine][row], "doc_id": best["doc_id"].to_numpy(), "d2": best["d2"].to_numpy(),
                              "n": np.where(first, n[row], 0)})
            )
        return pd.concat(found)

    return run


def _bucket_hits(queries: DataFrame, docs: DataFrame, how: Projections, k: int, probes: int) -> DataFrame:
    """``query_id, doc_id, d2, n``: per bucket the ``k`` nearest of each query; ``n`` adds up to its candidates.

    Pairs are never rows: a bucket's documents and queries meet in one place,
    or in pairs of blocks, and a pair counts in the first table it shares.
    """
    counts = [
        _placed(rows, name, how, p, whole=False).groupBy("table", "code").agg(F.count(F.lit(1)).alias("n"))
        for rows, name, p in ((queries, "query_id", probes), (docs, "doc_id", 0))
    ]
    blocks = [F.ceil(F.col(f"{side}.n") / BLOCK_ROWS).cast("int").alias(name) for side, name in (("q", "_q"), ("d", "_d"))]
    sizes = cut_lineage(
        counts[0].alias("q").join(counts[1].alias("d"), ["table", "code"]).select("table", "code", *blocks)
    )

    def dealt(rows: DataFrame, id_name: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return rows.join(sizes, ["table", "code"]).select(
            "table", "code", id_name, "vec", "codes", F.pmod(F.xxhash64(id_name), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
        )

    left = dealt(_placed(queries, "query_id", how, probes), "query_id", "_q", "_d", "qb", "db")
    right = dealt(_placed(docs, "doc_id", how, 0), "doc_id", "_d", "_q", "db", "qb")
    group = ["table", "code", "qb", "db"]
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "doc_id"))]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
        _met(k, how.tables, probes), f"query_id {kinds[0]}, doc_id {kinds[1]}, d2 double, n long"
    )


def approximate_nearest(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    how: Projections | None = None,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    doc_id: str = "doc_id",
    doc_vector: str = "embedding",
    probes: int = 2,
) -> DataFrame:
    """``query_id, doc_id, rank, distance, score, candidates`` of the nearest candidates, ties by ``doc_id``.

    Every document is in the tables and every query is asked; neighbours that
    share no bucket with their query are missed. :func:`recall` tells how many.
    Without ``how`` the intervals are fitted to a bounded sample.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q_vec"))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vector).alias("d_vec"))
    how = how or fit_length(held, Projections(), k, "d_vec")
    asked, held = asked.where("query_id IS NOT NULL"), held.where("doc_id IS NOT NULL")
    rows = cut_lineage(
        _bucket_hits(asked.withColumnRenamed("q_vec", "vec"), held.withColumnRenamed("d_vec", "vec"), how, k, probes)
    )
    counts = rows.groupBy("query_id").agg(F.sum("n").alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "doc_id"))
    hits = first_rows(rows.drop("n"), ["query_id"], ["d2", "doc_id"], k).withColumn("rank", rank)
    return hits.join(counts, "query_id").select(
        "query_id", "doc_id", "rank", F.sqrt("d2").alias("distance"), (1 / (1 + F.sqrt("d2"))).alias("score"), "candidates"
    )


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``query_id, hits, recall``: how many of a query's exact neighbours were found, of those it has (up to ``k``)."""
    wanted = exact.where(F.col("rank") <= k).select("query_id", "doc_id")
    marked = wanted.join(found.select("query_id", "doc_id", F.lit(1).alias("_found")), ["query_id", "doc_id"], "left")
    return marked.groupBy("query_id").agg(
        F.count("_found").alias("hits"), (F.count("_found") / F.count(F.lit(1))).alias("recall")
    )
