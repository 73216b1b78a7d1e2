"""Mixing sources to target weights by Poisson replication.

A document of source ``s`` is repeated ``Poisson(rate_s)`` times, where the
rate is the number of rows that the source should have over the number it has.
The count is the inverse of the Poisson distribution at a uniform number hashed
from seed, id and text, so a document's count depends on nothing but itself and
its source's rate. Copies are then dealt out in the order of another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.strings import let
from corpusloom.operators.skew import salted_join
from corpusloom.session import cut_lineage

from .common import is_small, whole_text

SEED = 17
# Weights follow the rows of a source to this power: 1 keeps the shares, 0 makes all equal.
TEMPERATURE = 0.5
# A higher rate is drawn as the sum of several draws, so that exp(-rate) stays exact.
RATE_PER_DRAW = 400


def _key(source: Column) -> Column:
    """A key that joins null with null and nothing else."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame,
    source: str = "source",
    weights: dict[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    total: float | None = None,
) -> DataFrame:
    """``_source, n_docs, rate`` for each source that occurs.

    ``weights`` gives target weights (a source that is not named has none and
    is left out of the mixture); by default they are the sources' rows to the
    power of ``temperature``. ``total`` is the wished number of rows, by
    default as many as there are.
    """
    counts = docs.groupBy(_key(F.col(source)).alias("_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("_weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        given = [("" if k is None else f"={k}", float(v)) for k, v in weights.items()]
        table = docs.sparkSession.createDataFrame(given, "_source string, _weight double")
        weighted = counts.join(F.broadcast(table), "_source", "left").fillna(0.0, ["_weight"])
    sums = weighted.agg(F.sum("_weight").alias("weights"), F.sum("n_docs").alias("docs")).first()
    wished = float(total if total is not None else sums["docs"] or 0)
    rate = F.lit(wished) * F.col("_weight") / F.lit(sums["weights"] or 1.0) / F.col("n_docs")
    return weighted.select("_source", "n_docs", rate.alias("rate"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """The rates with the cumulated distribution of one draw, up to where it is 1 in a double."""
    draws = F.greatest(F.ceil(F.col("rate") / RATE_PER_DRAW), F.lit(1)).cast("int")
    most = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 40).cast("int")
    first = F.exp(-F.col("_rate"))
    state = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("sums")),
        lambda s, k: let(
            s["p"] * F.col("_rate") / k,
            lambda p: F.struct(
                p.alias("p"), (s["sum"] + p).alias("sum"), F.array_append(s["sums"], s["sum"] + p).alias("sums")
            ),
        ),
    )
    return (
        rates.withColumn("_draws", draws)
        .withColumn("_rate", F.col("rate") / F.col("_draws"))
        .withColumn("_sums", state["sums"])
        .drop("_rate")
    )


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    source: str = "source",
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """Each document as often as its draw says, with ``copies`` and ``copy`` (from 0), in mixed order.

    Rows that are equal in id and text get the same count. Null sources are
    a source of their own; null ids and texts hash like empty ones. Documents
    of rate 0 and draws of 0 vanish, and an empty table stays empty. Columns
    called ``copies``, ``copy`` or ``shuffle_key`` are replaced; all others
    are carried along.

    Rates and distributions go to every task while they have at most
    ``SMALL_ROWS`` rows and ``SMALL_BYTES``, else they are joined by source with
    hot sources split. The only other
    shuffle deals the copies out by ``shuffle_key``.
    """
    docs = docs.drop("copies", "copy", "shuffle_key")
    # written once: the rates come from a count of all documents
    table = cut_lineage(_with_distribution(rates).select("_source", "_draws", "_sums"))
    keyed = docs.withColumn("_source", _key(F.col(source)))
    if is_small(table, F.octet_length("_source") + 8 * F.size("_sums")):
        joined = keyed.join(F.broadcast(table), "_source")
    else:
        joined = salted_join(keyed, table, ["_source"])
    identity = F.concat_ws(
        "|", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(whole_text(F.col(text_column)))
    )
    joined = joined.withColumn("_identity", identity)
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_draws")),
        F.lit(0),
        lambda n, i: n
        + let(
            _uniform(F.lit(str(seed)), F.col("_identity"), i.cast("string")),
            lambda u: F.size(F.filter(F.col("_sums"), lambda x: x <= u)),
        ),
    )
    order = F.substring(
        F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col("_identity"), F.col("copy").cast("string"))), 1, 16
    )
    return (
        joined.withColumn("copies", copies)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("shuffle_key", order)
        .drop("_source", "_draws", "_sums", "_identity")
        .transform(_in_order)
    )


def _in_order(copies: DataFrame) -> DataFrame:
    """Sorted by ``shuffle_key``. As it is spread evenly, its first digits tell the range; nothing is sampled."""
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    return copies.repartitionById(n, F.floor(leading * n / (1 << 32)).cast("int")).sortWithinPartitions("shuffle_key")


def mix_sources(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """:func:`replicate` with the rates of :func:`source_rates` for ``docs``."""
    return replicate(docs, source_rates(docs, **how), seed=seed)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixture with the columns of ``docs``, whatever they are called."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    return mix_sources(rows, **how).select("_row.*")


MIX_SQL = f"""
WITH docs AS (SELECT *, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS ident FROM documents),
counts AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n_docs) FROM counts) * n_docs ** {TEMPERATURE}
    / (SELECT sum(n_docs ** {TEMPERATURE}) FROM counts) / n_docs AS rate FROM counts),
drawn AS (
  SELECT source, greatest(ceil(rate / {RATE_PER_DRAW}), 1)::INT AS draws, rate / greatest(ceil(rate / {RATE_PER_DRAW}), 1) AS r
  FROM rates),
steps AS (
  SELECT source, k, sum(exp(k * ln(r) - r - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 40)::INT + 1)) AS k FROM drawn)),
uniform AS (
  SELECT doc_id, ident, source,
    ('0x' || substr(md5('{SEED}|' || ident || '|' || i), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM (SELECT d.*, unnest(range(1, draws + 1)) AS i FROM docs d JOIN drawn USING (source))),
counted AS (
  SELECT u.doc_id, u.ident, u.source, count(s.k) AS copies
  FROM uniform u LEFT JOIN steps s ON s.source = u.source AND s.upto <= u.u GROUP BY ALL)
SELECT d.doc_id, d.text, d.source, copies::INT AS copies, copy::INT AS copy,
  substr(md5('{SEED} order|' || d.ident || '|' || copy), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted WHERE copies > 0) c
JOIN docs d ON d.ident = c.ident"""
