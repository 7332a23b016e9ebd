"""Mix sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its source's target share of the wanted total over the
source's count. The variable is the inverse of the distribution function at a number in [0, 1) hashed from the seed and the document, so a
rerun, a lost executor or another partitioning draws the same. Means above ``STEP`` are sums of independent draws with smaller means.
The copies are dealt to partitions and ordered inside them by a hash, which is a random order of the whole mix.

Only DataFrame expressions are used. The counts per source are pre-aggregated; their table is broadcast while it has at most
``MOST_SOURCES`` rows and joined by shuffle beyond that, where adaptive execution splits a hot source.

Results for odd input: null is a source of its own; sources without a weight have weight 0 and are left out; documents that share a
doc_id are repeated alike; a null doc_id is drawn by the text, a null text as an empty one; an empty table stays empty; extra columns
are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20240131
STEP = 16.0  # the largest mean of one draw
TERMS = 96  # beyond it the tail of a mean of STEP is below 1e-40
MOST_SOURCES = 10_000

RATE, DRAWS, TABLE, KEY, ORDER, SOURCE, COPIES, COPY = (f"mix {x}" for x in ("rate", "draws", "table", "key", "order", "source", "copies", "copy"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _distribution(mean: Column) -> Column:
    """Array of the distribution function at 0, 1, ..., TERMS."""
    none = F.exp(-mean)

    def step(done: Column, k: Column) -> Column:
        term = done["term"] * mean / k
        return F.struct(F.array_append(done["sums"], done["sum"] + term).alias("sums"), term.alias("term"), (done["sum"] + term).alias("sum"))

    start = F.struct(F.array(none).alias("sums"), none.alias("term"), none.alias("sum"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["sums"]


def rates(documents: DataFrame, weights: dict | None = None, total: int | None = None, column: str = "source") -> DataFrame:
    """Per source: count, mean number of copies, draws, distribution function of one draw."""
    counts = documents.groupBy(F.col(column).alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        spark = documents.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"k {documents.schema[column].dataType.simpleString()}, w double")
        weighted = counts.join(given, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighted.agg(F.sum("w").alias("all w"), F.sum("n").alias("all n"))
    wanted = F.lit(float(total)) if total is not None else F.col("all n").cast("double")
    mean = F.when(F.col("all w") > 0, wanted * F.col("w") / F.col("all w") / F.col("n")).otherwise(F.lit(0.0))
    rated = weighted.join(F.broadcast(sums)).select("s", "n", mean.alias(RATE))  # one row
    draws = F.greatest(F.ceil(F.col(RATE) / F.lit(STEP)), F.lit(1)).cast("int")
    return rated.withColumn(DRAWS, draws).withColumn(TABLE, _distribution(F.col(RATE) / F.col(DRAWS))).withColumnRenamed("s", SOURCE)


def copies(documents: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = SEED, column: str = "source") -> DataFrame:
    """The documents repeated, with ``mix copy`` from 1 to ``mix copies`` and ``mix order``, a key that orders the mix."""
    table = rates(documents, weights, total, column)
    small = table.select(SOURCE).limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    table = table.select(SOURCE, DRAWS, TABLE)
    table = F.broadcast(table) if small else table
    own = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.withColumn(KEY, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rated = keyed.join(table, F.col(column).eqNullSafe(F.col(SOURCE)))
    numbers = F.transform(F.sequence(F.lit(1), F.col(DRAWS)), lambda j: uniform(F.lit(str(seed)), F.col(KEY), j.cast("string")))
    drawn = rated.withColumn(COPIES, F.aggregate(numbers, F.lit(0), lambda done, u: done + F.size(F.filter(F.col(TABLE), lambda p: p <= u))))
    many = drawn.where(F.col(COPIES) > 0).select(*own, KEY, COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES))).alias(COPY))
    return many.withColumn(ORDER, F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col(KEY), F.col(COPY).cast("string")))).drop(KEY)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The whole mix in random order."""
    return mixed.repartition(ORDER).sortWithinPartitions(ORDER)


def mix_sources(documents: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = SEED, column: str = "source") -> DataFrame:
    """The mix with the columns of the documents."""
    return shuffled(copies(documents, weights, total, seed, column)).select(*[F.col(f"`{c}`") for c in documents.columns])


def op8_poisson_mixing(spark, folder: str) -> DataFrame:
    """Every source with the same weight, as many rows as there are documents on average."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return shuffled(copies(documents)).select("doc_id", "source", F.col(COPIES).alias("copies"), F.col(COPY).alias("copy"), F.col(ORDER).alias("mix_order"), "text")


SQL = f"""
WITH per_source AS (
  SELECT source, count(*) AS n, (SELECT count(*) FROM documents) * 1.0::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) / count(*) AS rate
  FROM documents GROUP BY source
), steps AS (
  SELECT source, rate, greatest(ceil(rate / {STEP}), 1)::INT AS draws FROM per_source
), terms AS (
  SELECT source, draws, k, CASE WHEN k = 0 THEN exp(-rate / draws) ELSE exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)) END AS p
  FROM steps, (SELECT unnest(generate_series(0, {TERMS})) AS k)
), sums AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), draw AS (
  SELECT rid, doc_id, text, d.source, j,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || j), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(generate_series(1, s.draws)) AS j)
), drawn AS (
  SELECT doc_id, text, d.source, (count(*) FILTER (c <= u))::INT AS copies
  FROM draw d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source GROUP BY rid, doc_id, text, d.source
)
SELECT doc_id, source, copies, copy::INT AS copy, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || copy) AS mix_order, text
FROM drawn, LATERAL (SELECT unnest(generate_series(1, copies)) AS copy) WHERE copies > 0
"""
