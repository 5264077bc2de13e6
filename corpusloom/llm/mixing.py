"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, fresh, staged

#: Hex digits of a row's hash that name its bin: 4096 bins a source bound every window over bins.
BIN_DIGITS = 3
#: Up to so many sources, their limits (about 100 bytes each) are broadcast; beyond it they're joined with salt.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def water_levels(totals: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """totals(sk, source, source_size) with `target`.

    Sources fill in the order of limit / weight. A source is clamped if the level that the rest would reach
    with all earlier ones clamped lies above its own; that is where repeated clamping and resharing by weight
    ends. The windows here hold one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    before = W.orderBy(F.col("cap") / F.col("w"), "sk").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("full", F.col("w") * F.col("left") / F.col("w_left") >= F.col("cap"))
        .withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    )
    return filled.select("sk", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("rest") / F.col("w_rest")).alias("target"))


def source_limits(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """For sized(sk, source, key, size): a row per source with its target and where its last repetition ends.

    whole: repetitions of every row. Rows whose key is below edge_key are taken once more; rows at edge_key
    share `edge_part` words in proportion to their size. Sums over 4096 bins of the key come first, so no
    window holds more than a source's bins or one bin's keys.
    """
    bins = staged(sized.groupBy("sk", "source", F.substring("key", 1, BIN_DIGITS).alias("bin")).agg(F.sum("size").alias("bin_size")), "mix-bins")
    totals = bins.groupBy("sk", "source").agg(F.sum("bin_size").alias("source_size"))
    levels = water_levels(totals, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    levels = levels.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    levels = staged(levels, "mix-levels")
    up_to = W.partitionBy("sk").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    edge_bins = (
        bins.withColumn("under", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)))
        .join(levels.select("sk", "extra"), "sk")
        .filter((F.col("under") < F.col("extra")) & (F.col("under") + F.col("bin_size") >= F.col("extra")))
        .select("sk", "bin", (F.col("extra") - F.col("under")).alias("need"))
    )
    keys = (
        sized.withColumn("bin", F.substring("key", 1, BIN_DIGITS)).join(edge_bins, ["sk", "bin"])
        .groupBy("sk", "bin", "key", "need").agg(F.sum("size").alias("key_size"))
    )
    up_to_key = W.partitionBy("sk", "bin").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        keys.withColumn("under", F.coalesce(F.sum("key_size").over(up_to_key), F.lit(0)))
        .filter((F.col("under") < F.col("need")) & (F.col("under") + F.col("key_size") >= F.col("need")))
        .select("sk", F.col("key").alias("edge_key"), "key_size", (F.col("need") - F.col("under")).alias("edge_part"))
    )
    return levels.join(edges, "sk", "left")


def _with_limits(rows: DataFrame, limits: DataFrame, sk: str, key: str) -> DataFrame:
    """rows joined with their source's limits; a hot source is spread by the join's salt or a broadcast of checked size."""
    limits = staged(limits, "mix-limits")
    if limits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(limits), rows[sk] == limits["sk"]).drop(limits["sk"])
    salted = limits.withColumn("_salt", F.explode(F.array(*[F.lit(f"{x:02x}") for x in range(256)])))
    return rows.join(salted, (rows[sk] == salted["sk"]) & (F.substring(rows[key], 1, 2) == salted["_salt"])).drop(salted["sk"], "_salt")


def _extra(key: Column, size: Column) -> Column:
    return F.when(F.col("edge_key").isNull() | (key > F.col("edge_key")), F.lit(0)).when(key < F.col("edge_key"), size).otherwise(F.floor(F.col("edge_part") * size / F.col("key_size"))).cast("long")


def taken_words(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """What a mix takes from each document: doc_id, size, source_size, target, taken.

    Sources in code-point order, null last, get the weights in turn and share `share` times all words; a
    source gives at most max_epochs times its words and the rest is reshared by weight. Every document is
    taken whole floor(target / source_size) times; once more in the order of a seeded hash of doc_id until
    the target is met, the last one in part. A null text has size 0; a null source is a source of its own;
    rows with one doc_id share the hash, and if the edge falls on them, its words in proportion; an empty
    table gives no rows.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).select("doc_id", "source", "size", _source_key(F.col("source")).alias("sk"), _key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    limits = source_limits(sized, weights, share, max_epochs)
    return _with_limits(sized, limits, "sk", "key").select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + _extra(F.col("key"), F.col("size"))).alias("taken"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each repetition.

    Choices as in taken_words(), for very long texts too; an empty table gives no rows. A repetition in part holds the text's first words (for a source's last
    document only); documents without words follow their source's whole repetitions.
    """
    size, sk, key, times, part, limit = fresh(docs, "_mix_size", "_mix_sk", "_mix_key", "_mix_times", "_mix_part", "_mix_limit")
    rows = docs.withColumn(size, word_count(F.col("text"))).withColumn(sk, _source_key(F.col("source"))).withColumn(key, _key(F.col("doc_id"), seed))
    sized = staged(rows.select("source", F.col(size).alias("size"), F.col(sk).alias("sk"), F.col(key).alias("key")), "mix-sizes")
    limits = source_limits(sized, weights, share, max_epochs).select("sk", F.struct("whole", "edge_key", "edge_part", "key_size").alias(limit))
    joined = _with_limits(rows, limits, sk, key)
    lim = lambda c: F.col(f"{limit}.{c}")
    extra = F.when(lim("edge_key").isNull() | (F.col(key) > lim("edge_key")), F.lit(0)).when(F.col(key) < lim("edge_key"), F.col(size)).otherwise(F.floor(lim("edge_part") * F.col(size) / lim("key_size"))).cast("long")
    joined = joined.withColumn(part, extra)
    # A repetition is the number of words it keeps; -1 keeps the text as it is.
    whole = F.when(lim("whole") > 0, F.array_repeat(F.lit(-1).cast("long"), lim("whole").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    last = F.when(F.col(part) <= 0, F.array().cast("array<bigint>")).when(F.col(part) >= F.col(size), F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col(part)))
    repeated = joined.withColumn(times, F.explode(F.concat(whole, last)))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1)), 1, F.greatest(F.col(times), F.lit(0)).cast("int")), "")
    return repeated.withColumn("text", F.when(F.col(times) < 0, F.col("text")).otherwise(first_words)).select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS sk, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), totals AS (
  SELECT sk, source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY sk, source
), steps AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(source_size * 2.0::DOUBLE) OVER earlier, 0) AS left_size,
         sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS w_left
  FROM totals WINDOW earlier AS (ORDER BY source_size * 2.0::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (SELECT *, w * left_size / w_left >= cap AS is_full FROM steps
), levels AS (
  SELECT sk, source_size, CASE WHEN is_full THEN cap ELSE w * (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / (sum(w) FILTER (WHERE NOT is_full) OVER ()) END AS target
  FROM marked
), amounts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM levels
), placed AS (
  SELECT doc_id, size, a.source_size, target, whole, round(target - whole * a.source_size)::BIGINT AS extra,
         coalesce(sum(size) OVER (PARTITION BY s.sk ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS upto,
         (sum(size) OVER (PARTITION BY s.sk, key))::BIGINT AS key_size
  FROM sized s JOIN amounts a ON s.sk = a.sk
)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= extra THEN size WHEN upto - key_size >= extra THEN 0
         ELSE floor((extra - (upto - key_size)) * size / key_size) END)::BIGINT AS taken
FROM placed
"""
