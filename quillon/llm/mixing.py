"""9. Mixing sources to target weights by Poisson replication.

Each source's target rate is (its share of the weights) * (total rows wanted) / (its rows). A document's count is drawn
by inverting the Poisson distribution with that mean at a number that its id and text hash to, under a seed; so the
draw is the same in every run and on every partitioning. The document is exploded by its count, and the copies are
shuffled globally: they are dealt to partitions and sorted by an md5 key of (seed, id, copy).

The inverse is exact for any rate: a rate is written as a sum of equal rates of at most ``MAX_RATE``, each drawn with its
own number (a sum of Poisson variables is Poisson), so that thresholds stay short and never underflow.

Edge cases: a source without a given weight, and the null source, weigh ``default_weight``; weight 0 removes a source;
null ids and texts are drawn like others; repeated rows draw the same count each; an empty table gives no rows. Extra
columns stay; ``copy`` and ``shuffle_key`` are added, over columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 17
MAX_RATE = 8.0
TERMS = 64  # the chance to exceed 63 at rate 8 is below 1e-30, below the grain of a 52-bit draw
SMALL = 10_000  # sources that are broadcast; more are joined by shuffle, salted


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate): the mean number of copies of each document of a source. total: rows wanted, as many as docs if None."""
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_docs"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col(source_col).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    whole = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"))  # one row
    out = counts.crossJoin(F.broadcast(whole))
    wanted = F.col("all_docs").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("n_docs")).otherwise(F.lit(0.0))
    return out.select(source_col, "n_docs", rate.alias("rate"))


def _thresholds() -> str:
    """Cumulative Poisson probabilities P(X <= k) for k < TERMS at the rate of one part."""
    terms = ", ".join(f"{1 / math.factorial(k)!r}D * pow(part_rate, {k})" for k in range(TERMS))
    return f"aggregate(array({terms}), cast(array() as array<double>), (acc, p) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0D) + p * exp(-part_rate))))"


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, total: float | None = None, seed: int = SEED, source_col: str = "source") -> DataFrame:
    """docs, each as often as drawn, with copy (from 1) and shuffle_key, in a global random order."""
    per = rates(docs, weights, default_weight, total, source_col)
    per = per.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")).withColumn("part_rate", F.col("rate") / F.col("parts"))
    per = per.withColumn("_cdf", F.expr(_thresholds())).select(F.col(source_col).alias("_source"), "parts", "_cdf")
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    same = F.col(source_col).eqNullSafe(F.col("_source"))
    if len(per.select("_source").take(SMALL + 1)) <= SMALL:
        joined = docs.select(*names).join(F.broadcast(per), same)
    else:
        salts = 64
        salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = docs.select(*names).withColumn("_s", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")).join(salted, same & (F.col("_s") == F.col("_salt")))
    digest = "md5(cast(coalesce(text, '') as binary))"
    joined = joined.withColumn("_digest", F.expr(digest))
    draw = f"conv(substr(md5(cast(concat_ws('/', '{seed}', p, coalesce(cast(doc_id as string), ''), _digest) as binary)), 1, 13), 16, 10) / 4503599627370496D"
    drawn = joined.withColumn("_u", F.expr(f"transform(sequence(1, parts), p -> {draw})"))
    count = F.expr("aggregate(_u, 0, (n, u) -> n + size(filter(_cdf, c -> c <= u)))")
    out = drawn.withColumn("_n", count).where("_n > 0").withColumn("copy", F.explode(F.expr("sequence(1, _n)")))
    out = out.withColumn("shuffle_key", F.expr(f"md5(cast(concat_ws('/', '{seed}', 'order', coalesce(cast(doc_id as string), ''), _digest, cast(copy as string)) as binary))"))
    return out.select(*names, "copy", "shuffle_key").repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


#: The production weights of the test tables' sources: the hot source is damped, two are raised.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS)


SQL = f"""
WITH c AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END AS w FROM documents GROUP BY 1),
r AS (SELECT source, w / sum(w) OVER () * sum(n) OVER ()::DOUBLE / n AS rate FROM c),
q AS (SELECT source, greatest(1, ceil(rate / 8))::INT AS parts, rate / greatest(1, ceil(rate / 8)) AS rate FROM r),
t AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM q, range(0, {TERMS}) AS g(k)),
u AS (SELECT doc_id, d.source, text, md5(coalesce(text, '')) AS digest, p,
             ('0x' || substr(md5(concat_ws('/', '{SEED}', p, coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496 AS u
      FROM documents d JOIN q USING (source), unnest(range(1, parts + 1)) AS g(p)),
n AS (SELECT doc_id, u.source, any_value(text) AS text, any_value(digest) AS digest, count(*) AS n FROM u JOIN t ON t.source = u.source AND t.cdf <= u.u GROUP BY 1, 2)
SELECT doc_id, source, text, copy::INT AS copy, md5(concat_ws('/', '{SEED}', 'order', coalesce(doc_id::VARCHAR, ''), digest, copy::VARCHAR)) AS shuffle_key
FROM n, unnest(range(1, n + 1)) AS g(copy)
"""
QUERIES = {"op9_mix": (op9_mix, SQL)}
