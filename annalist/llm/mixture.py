"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame operations only.

1. Sizes (words) are summed by source and shard; a source has one shard for about SHARD_TOKENS of its words, but at most
   MAX_SHARDS, chosen by a hash of the document, so a source that holds a third of all rows is many shards.
2. Targets: sources share the mix by weight; a target stops at `most` times its source's size and the excess goes to
   the others by weight. Sorted by size over weight, the sources that stop are a prefix, so one window finds them.
3. All blocks have the same number of words: a part, one in FINENESS, of the smallest positive target, at least one word
   and at most BLOCK_TOKENS, so no source's share is lost in rounding. They go to sources by highest quotients
   target / (2 n + 1), then a source's blocks go to its shards in the same way. Divisors just above and below the average
   bracket the last quotient that wins, so only about two candidates a source are ranked, however many blocks there are.
4. Inside a shard the documents are laid end to end in the order of a seeded hash (md5, which other engines have too).
   That stream is read from its start until the shard's blocks are full, again and again if they are more than it.

The text is read once, to count words; what is kept of it (id, source, size) is cut off by a checkpoint. Windows over all
sources and over a source's shards hold one row for each, and no text; a shard's window holds its ids and sizes.

Defined results: null or wordless texts have size 0 and are not taken; a source without words has target 0; null sources
are one source, last in order; repeated rows are rows of their own, and which of rows with the same id and size comes
first makes no difference; a very long text is one document, taken whole or in part like others, up to `most` times its
size; an empty table gives no rows; columns that the method adds win over columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.shared import checkpointed

BLOCK_TOKENS = 512
FINENESS = 200
SHARD_TOKENS = 1 << 20
MAX_SHARDS = 1 << 12
MOST = 3
_ADDED = ("size", "source_size", "target", "taken")


def word_count(text: str) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`: characters that are no blanks and follow a blank or nothing."""
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " +"), lambda w: w != "")).cast("bigint")


def _draw(key: str, seed: int, start: int, digits: int) -> Column:
    """A number from some digits of the hash of a document's id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), start, digits), 16, 10).cast("bigint")


def cycled_weight(position: Column) -> Column:
    """Weights 1, 2, 3, repeating."""
    return (F.pmod(position, F.lit(3)) + 1).cast("double")


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target; `source` is distinct. There are as many rows as sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", cycled_weight(F.row_number().over(order) - 1)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # if the sources before this one stop at their caps, the rest is shared at this rate; the first whose cap isn't reached sets the rate, the highest of those that fit
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rated = weighed.withColumn("rate", F.when(rate * F.col("weight") <= F.col("cap"), rate))
    return rated.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(F.max("rate").over(every), F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, share: str, seats: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the integer column `name`: `seats` (the same for all rows of a group) dealt by highest quotients
    share / (2 n + 1), ties by `order`."""
    group = Window.partitionBy(*by)
    total, n = F.sum(share).over(group), F.count(F.lit(1)).over(group)
    framed = parties.withColumns({"_seats": seats.cast("bigint"), "_total": total, "_n": n})
    exact = F.when(F.col("_total") > 0, F.col(share) / F.col("_total")).otherwise(0.0)
    # with seats - n/2 in the place of seats no party gets a seat that it would lose; with seats + n/2 all winners are candidates
    least = F.greatest(F.lit(0.0), F.floor(exact * F.greatest(F.lit(0.0), F.col("_seats") - F.col("_n") / 2.0) + 0.5) - 1).cast("bigint")
    most = (F.floor(exact * (F.col("_seats") + F.col("_n") / 2.0) + 0.5) + 1).cast("bigint")
    framed = framed.withColumns({"_least": least, "_most": F.when(F.col(share) > 0, most).otherwise(least)})
    framed = framed.withColumn("_left", F.col("_seats") - F.sum("_least").over(group))
    key = [*by, *order]
    candidates = framed.select(*key, share, "_left", F.explode(F.sequence("_least", "_most")).alias("_k")).where(F.col(share) > 0)
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *(F.col(c).asc_nulls_last() for c in order), "_k")))
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    joined = framed.alias("f").join(won.alias("w"), [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key], "left")
    return joined.select(*(F.col(f"f.`{c}`") for c in parties.columns), (F.col("_least") + F.coalesce("_won", F.lit(0))).alias(name))


def mix_sources(documents: DataFrame, seed: int = 42, text: str = "text", source: str = "source", key: str = "doc_id", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, most: int = MOST) -> DataFrame:
    """key, source, size, source_size, target and taken (words that the mix takes, repeats counted) for each document."""
    sized = checkpointed(documents.select(F.col(key).alias("doc"), F.col(source).alias("source"), word_count(text).alias("size")))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    framed = by_source.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / FINENESS))), F.lit(1)).cast("bigint"))
    blocks = apportion(framed, "target", F.ceil(F.sum("source_size").over(every) / F.col("block")), [], ["source"], "blocks")
    shards = F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_tokens))).cast("int")
    plan = checkpointed(blocks.withColumn("shards", shards))

    doc = sized.alias("d").join(plan.select("source", "shards").alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    doc = doc.select("d.doc", F.col("d.source").alias("source"), "size", _draw("d.doc", seed, 1, 15).alias("draw"), F.pmod(_draw("d.doc", seed, 17, 8), "shards").alias("shard"))
    cells = doc.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.source", "shard", "cell_size", "source_size", "target", "block", "blocks")
    quotas = apportion(cells, "cell_size", F.col("blocks"), ["source"], ["shard"], "quota")

    placed = doc.withColumn("end", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("draw", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    tokens = F.least(F.col("quota") * F.col("block"), F.lit(most) * F.col("cell_size"))
    rounds, rest = F.expr("div(tokens, greatest(cell_size, 1))"), F.expr("pmod(tokens, greatest(cell_size, 1))")
    part = F.greatest(F.lit(0), F.least("end", rest) - F.least(F.col("end") - F.col("size"), rest))
    return joined.withColumn("tokens", tokens).select(F.col("doc").alias(key), F.col("d.source").alias(source), "size", "source_size", "target", (F.col("size") * rounds + part).cast("bigint").alias("taken"))


def oracle_sql(seed: int = 42, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, most: int = MOST) -> str:
    """mix_sources(documents) without the source, for DuckDB: caps found source by source, every quotient ranked."""

    def digits(start: int, n: int) -> str:
        return f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {start}, {n}))::BIGINT"

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, size, row_number() OVER (ORDER BY source NULLS LAST) AS id, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
 r AS (SELECT id, source, size, weight, {most}.0::DOUBLE * size AS cap, row_number() OVER (ORDER BY {most}.0::DOUBLE * size / weight, source NULLS LAST) AS place FROM s),
 steps(place, rate) AS (SELECT 0::BIGINT, (SELECT sum(size)::DOUBLE / sum(weight) FROM r)
  UNION ALL SELECT t.place + 1, (SELECT (sum(size)::DOUBLE - sum(CASE WHEN place <= t.place + 1 THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN place > t.place + 1 THEN weight ELSE 0 END), 0) FROM r)
   FROM steps t JOIN r ON r.place = t.place + 1 WHERE t.rate * r.weight > r.cap),
 rate AS (SELECT coalesce(arg_max(rate, place), 'infinity'::DOUBLE) AS rate FROM steps),
 t AS (SELECT r.*, least(cap, weight * rate) AS target FROM r, rate),
 b AS (SELECT greatest(1, least({block_tokens}, floor(min(CASE WHEN target > 0 THEN target END) / {FINENESS})))::BIGINT AS block, (SELECT sum(size) FROM t) AS total FROM t),
 seats AS (SELECT CAST(ceil(total / block) AS BIGINT) AS seats, coalesce(block, 1) AS block FROM b),
 ranked AS (SELECT id, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place FROM t, seats, range(CAST(floor(target / (SELECT sum(target) FROM t) * (seats + (SELECT count(*) FROM t))) AS BIGINT) + 2) q(k) WHERE target > 0),
 won AS (SELECT id, count(*) AS blocks FROM ranked, seats WHERE place <= seats GROUP BY id),
 p AS (SELECT t.id, t.source, t.size AS source_size, target, coalesce(blocks, 0) AS blocks, CAST(greatest(1, least({MAX_SHARDS}, ceil(t.size / {shard_tokens}))) AS BIGINT) AS shards FROM t LEFT JOIN won USING (id)),
 e AS (SELECT d.doc_id, d.size, p.id, {digits(1, 15)} AS draw, {digits(17, 8)} % shards AS shard FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
 c AS (SELECT id, shard, sum(size)::BIGINT AS cell, sum(sum(size)) OVER (PARTITION BY id) AS whole, count(*) OVER (PARTITION BY id) AS n FROM e GROUP BY id, shard),
 quotients AS (SELECT c.id, shard, row_number() OVER (PARTITION BY c.id ORDER BY cell / (2 * k + 1) DESC, shard, k) AS place FROM c JOIN p USING (id), range(CAST(floor(cell / whole * (blocks + n)) AS BIGINT) + 2) q(k) WHERE cell > 0),
 quotas AS (SELECT q.id, q.shard, count(*) AS quota FROM quotients q JOIN p USING (id) WHERE place <= blocks GROUP BY q.id, q.shard),
 laid AS (SELECT *, sum(size) OVER (PARTITION BY id, shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM e),
 f AS (SELECT doc_id, laid.size, source_size, target, stop, greatest(cell, 1) AS cell, least(coalesce(quota, 0) * (SELECT block FROM seats), {most} * cell)::BIGINT AS tokens FROM laid JOIN c USING (id, shard) JOIN p USING (id) LEFT JOIN quotas USING (id, shard))
SELECT doc_id, size, source_size, target, CAST(size * (tokens // cell) + greatest(0, least(stop, tokens % cell) - least(stop - size, tokens % cell)) AS BIGINT) AS taken FROM f
"""
