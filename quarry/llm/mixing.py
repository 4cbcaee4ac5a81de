"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within its source, in order of (size, id), each document expects ``target / source size`` copies. The
prefix sum of the expected copies plus the source's random offset crosses an integer once for each
copy that is taken. Going through a source by size makes every stretch of sizes give its share, so
the words that are taken stay near the target.

The prefix sum runs over ranges: rows are dealt by range of (source, size, id), so a hot source is
spread over many ranges; each range is numbered alone and starts where the counts before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh, materialise

#: Weights of the sources in order, repeating; a target's limit in sizes of its source; seed of the offsets.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17
#: Parts in which rows that agree in id, source and size are numbered.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, place, target).

    A target is ``least(most * size, level * weight)``. Sources by their limit a weight: those before
    the first whose share stays within its limit are full. One row a source, ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")
    limit = F.lit(most).cast("long") * F.col("source_size")
    ratio = F.col("limit").cast("double") / F.col("weight")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    table = sources.withColumn("place", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", ratio)
    table = table.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0).cast("long"))).withColumn("open", F.sum("weight").over(after))
    fits = F.col("left").cast("double") / F.col("open") <= F.col("ratio")
    first = F.min(F.when(fits, F.struct("ratio", "place", "left", "open"))).over(every)
    table = table.withColumn("level", first)
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")
    return table.select("source", "source_size", "place", F.least(F.col("limit").cast("double"), share).alias("target"))


def offset(place: Column, seed: int = SEED) -> Column:
    """One number from 0 to 1 for each source: a linear congruential step of its place and the seed."""
    return F.pmod((place + seed) * 1103515245 + 12345, F.lit(1 << 31)).cast("double") / float(1 << 31)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, last in order. A document of size 0
    has copies like any other of its source, and takes no words; in a source without words copies
    are 0. Rows repeated with one id are sampled each alone; null ids come first among equal sizes. An
    empty table gives an empty result. Only the named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows, "sizes")  # finding the ranges reads them twice
    ranges = rows.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size"), F.col("id")).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")
    counts = ranges.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialise(counts, "counts")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("start"))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    starts = starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "part", "start", "source_size", "place", "target")
    numbered = ranges.withColumn("number", F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "id")).cast("long"))
    joined = numbered.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part")))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    crossed = lambda number: F.floor(number.cast("double") * F.col("rate") + F.col("offset")).cast("long")
    at = F.col("start") + F.col("number")
    copies = F.least(crossed(at) - crossed(at - 1), F.lit(most).cast("long"))
    return joined.select("id", "r.source", "size", "source_size", "target", "start", "number", rate.alias("rate"), offset(F.col("place"), seed).alias("offset")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with all columns, each row as often as the mix takes it."""
    names = docs.columns
    id_, source, size, m_id, m_source, m_size, copies, copy, salt, before, number = fresh(docs, "id", "source", "size", "m_id", "m_source", "m_size", "copies", "copy", "salt", "before", "number")
    many = fresh(docs, *(f"times{k}" for k in range(MOST + 1)))
    key = {id_: F.col(id_col), source: F.col(source_col), size: word_count(F.col(text_col))}
    drawn = mix(docs, id_col, text_col, source_col).select(F.col(id_col).alias(m_id), F.col(source_col).alias(m_source), F.col("size").alias(m_size), "copies")
    drawn = drawn.groupBy(m_id, m_source, m_size).agg(*(F.count_if(F.col("copies") == k).alias(many[k]) for k in range(MOST + 1)))
    drawn = materialise(drawn, "drawn")
    taken = drawn.filter(sum(map(F.col, many[1:])) > 0)
    match = F.col(id_).eqNullSafe(F.col(m_id)) & F.col(source).eqNullSafe(F.col(m_source)) & (F.col(size) == F.col(m_size))
    alone = sum(map(F.col, many)) == 1
    rows = docs.withColumns(key)
    # the table grows with the documents, so the join is by shuffle at every size
    out = rows.join(taken.filter(alone).hint("merge"), match).withColumn(copies, sum(F.col(many[k]) * k for k in range(1, MOST + 1)))
    if not taken.filter(~alone).isEmpty():  # rows that agree in id, source and size share out what was drawn for them
        like = materialise(rows.join(taken.filter(~alone), match).withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS))), "like")
        earlier = Window.partitionBy(id_, source, size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
        starts = like.groupBy(id_, source, size, salt).agg(F.count("*").alias(copy)).withColumn(before, F.coalesce(F.sum(copy).over(earlier), F.lit(0).cast("long")))
        starts = starts.select(F.col(id_).alias("s_id"), F.col(source).alias("s_source"), F.col(size).alias("s_size"), F.col(salt).alias("s_salt"), before)
        like = like.withColumn(number, F.row_number().over(Window.partitionBy(id_, source, size, salt).orderBy(text_col)))
        like = like.alias("l").join(starts.alias("s"), F.col(f"l.{id_}").eqNullSafe(F.col("s.s_id")) & F.col(f"l.{source}").eqNullSafe(F.col("s.s_source")) & (F.col(f"l.{size}") == F.col("s.s_size")) & (F.col(f"l.{salt}") == F.col("s.s_salt")))
        place, each, upto = F.col(number) + F.col(before), F.lit(0).cast("long"), F.lit(0).cast("long")
        for k in range(MOST, 0, -1):
            each = F.when((place > upto) & (place <= upto + F.col(many[k])), F.lit(k).cast("long")).otherwise(each)
            upto = upto + F.col(many[k])
        out = out.select(*names, copies).unionByName(like.withColumn(copies, each).select(*(F.col(f"l.{n}") for n in names), copies))
    return out.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*names)


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM p),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
             CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open FROM r),
f AS (SELECT rest, open FROM l WHERE rest / open <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, place, least(CAST(cap AS DOUBLE), f.rest * weight / f.open) AS target FROM l, f),
n AS (SELECT d.doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k,
             CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
             CAST(((place + {SEED}) * 1103515245 + 12345) % 2147483648 AS DOUBLE) / 2147483648 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) AS copies,
       size * CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) AS BIGINT) AS taken
FROM n
"""
