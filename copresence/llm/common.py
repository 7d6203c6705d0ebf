"""What the operators of this package share: written tables, connected components, learnable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from copresence.session import scratch


#: Rows of a narrow table that one task handles well.
ROWS_PER_TASK = 100_000


def saved(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write to the cluster's shared folder and read back: later steps survive a lost executor and repeat no work.

    `rows`, an upper bound of the rows of a narrow table, keeps small tables from being spread over many tasks and files.
    """
    path = scratch(df.sparkSession, label)
    (df if rows is None else df.coalesce(1 + rows // ROWS_PER_TASK)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, rows: int | None = None, **more: Column) -> tuple[DataFrame, dict]:
    """`saved`, and what was observed while writing: `n` rows, and `more` aggregates."""
    seen = Observation()
    out = saved(df.observe(seen, F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()]), label, rows)
    return out, seen.get


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as every worker must read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b), both long: one row (node, root) for each node with a link,
    root being the smallest node of its component.

    Rounds of large-star and small-star steps: every node sends its larger, then its smaller neighbours to the smallest
    node it knows. Rounds go on until nothing changes. Neighbourhoods are only ever reduced to a minimum, with sums
    before the shuffle, so a node may have any number of links.
    """
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))  # equal for equal sets of links
    now, seen = counted(_downward(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links", mixed=mixed)
    while n := seen["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows", 2 * n)
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large, "large", 2 * n)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "lows", 2 * n)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = seen
        now, seen = counted(_downward(small.unionByName(low.withColumnRenamed("m", "v"))), "links", 2 * n, mixed=mixed)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _downward(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))
