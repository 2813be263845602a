"""Mixing sources to target weights by Poisson replication: each document's count is a Poisson number, inverted from a hash of its id, with the
mean rate that its source's target weight asks for; documents are exploded by their count and shuffled globally.

The rate of a source is weight x rows of the table / rows of the source, so the mixture has about as many rows as the table. Without given weights
each source weighs the same; sources without a given weight get none. A null source is a source of its own. Null or repeated ids draw by the
same hash, so repeated rows get equal counts and are told apart by nothing but their place. Texts, also very long ones, are carried whole and never
looked at. An empty table gives an empty result. Columns keep their names and order; `copy`, `mix_key` and `rate` are appended (an input's own columns of these names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
#: A rate is split into parts of at most this mean; their Poisson numbers are added, so that exp(-rate) never underflows.
PART = 32.0
#: Parts of a document's rate that are drawn in one row; a document with more is spread over rows, so that a tiny source is no long array in one task.
PARTS_AT_ONCE = 32
#: Terms of the distribution that are summed; beyond them a part of mean 32 has a probability under 1e-16.
TERMS = 120


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson number, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * rate / k)).alias("all")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate, parts, cdf): counted over all rows; one row per source."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(given, F.coalesce("mix_source", F.lit(""))), F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0)
    rates = weighed.join(F.broadcast(total), F.lit(True)).select("mix_source", rate.alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    return rates.withColumn("parts", parts).withColumn("cdf", distribution(F.col("rate") / F.col("parts")))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, most_sources: int = 10_000) -> DataFrame:
    """The mixture in its global random order: sorted by mix_key over range partitions.

    The table of rates is broadcast if it has at most most_sources rows, counted before; else rows and rates meet by a shuffle on the source,
    of which Spark splits the large ones."""
    spark = docs.sparkSession
    rates = source_rates(docs, weights, source_col)
    sizes = rates.agg(F.count("*").alias("n"), F.coalesce(F.max("parts"), F.lit(0)).alias("parts")).first()
    rates = F.broadcast(rates) if sizes["n"] <= most_sources else rates.repartition("mix_source")
    kept = [c for c in docs.columns if c not in ("copy", "mix_key", "rate")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"))
    rows = packed.join(rates, F.col("source").eqNullSafe(F.col("mix_source")), "left")

    def drawn(first: Column, last: Column) -> Column:
        draws = F.transform(F.sequence(first, last), lambda k: uniform(F.lit(seed), F.col("id"), k))  # hashed once a part, not once a term
        return F.aggregate(draws, F.lit(0), lambda total, u: total + F.size(F.filter("cdf", lambda c: c <= u)))

    if sizes["parts"] <= PARTS_AT_ONCE:
        counted = rows.withColumn("mix_n", drawn(F.lit(1), F.col("parts"))).withColumn("before", F.lit(0).cast("long"))
    else:
        block = F.explode(F.sequence(F.lit(0), F.expr(f"cast((coalesce(parts, 1) - 1) div {PARTS_AT_ONCE} as int)"))).alias("block")
        # The draws depend on the id alone: they are made once for each id and block, spread by hash, and numbered on within an id.
        own = rows.select("source", "id", "parts", "cdf").dropDuplicates(["source", "id"]).select("source", "id", "parts", "cdf", block).repartition("source", "id", "block")
        own = own.withColumn("mix_n", drawn(F.col("block") * PARTS_AT_ONCE + 1, F.least(F.col("parts"), (F.col("block") + 1) * PARTS_AT_ONCE)))
        w = Window.partitionBy("source", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        own = own.select(F.col("source").alias("s"), F.col("id").alias("i"), "block", "mix_n", F.coalesce(F.sum("mix_n").over(w), F.lit(0)).alias("before")).where("mix_n > 0").repartition("s", "i", "block")
        counted = rows.drop("cdf").join(own, F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")))
    counted = counted.where("mix_n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_n")))).withColumn("copy", (F.col("before") + F.col("copy")).cast("int"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy")).cast("binary")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Keys are evenly spread, so equal ranges of their first 32 bits are the range partitions; no sample of the rows is drawn first.
    part = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * parts / F.lit(2.0**32)).cast("int")
    dealt = keyed.select("row", "copy", "mix_key", "rate").repartitionById(parts, part).sortWithinPartitions("mix_key")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "copy", "mix_key", "rate")


ORACLE_SQL = r"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (sum(1.0::DOUBLE) OVER ()) * (sum(n) OVER ())::DOUBLE / n AS rate FROM counts),
parted AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS parts FROM rates),
draws AS (
  SELECT d.doc_id, d.source, p.rate, p.rate / p.parts AS lam, k.k,
    ('0x' || substr(md5('mix-1|' || d.doc_id || '|' || k.k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS k) k
), cdf AS (
  SELECT source, j, sum(exp(-lam + j * ln(lam) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS c
  FROM (SELECT DISTINCT source, lam FROM draws), (SELECT unnest(range(0, 121)) AS j)
), numbers AS (
  SELECT d.doc_id, d.source, d.rate, d.k, count(c.j) AS x FROM draws d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY ALL
), totals AS (SELECT doc_id, source, rate, sum(x)::INT AS n FROM numbers GROUP BY ALL)
SELECT doc_id, source, CAST(c.copy AS INT) AS copy, md5('mix-1|order|' || doc_id || '|' || c.copy) AS mix_key, CAST(round(rate * 1000000) AS BIGINT) AS rate_ppm,
  CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
FROM totals JOIN documents USING (doc_id, source), LATERAL (SELECT unnest(range(1, n + 1)) AS copy) c
"""
