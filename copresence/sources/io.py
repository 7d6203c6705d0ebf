"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copresence.sources import schemas

BAD_LINE = "_bad_line"


def read_pings(spark: SparkSession, path: str | list[str], cols: list[str] | None = None, schema: str = schemas.PINGS) -> DataFrame:
    """Tab-separated parts, gzipped or plain; only the asked columns are parsed."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.select(*cols) if cols else df


def write_landing(df: DataFrame, root: str, time: str = "timestamp") -> None:
    """Tab-separated parts in one folder per month and day (UTC)."""
    at = F.timestamp_seconds(time)
    df.withColumns({"month": F.month(at), "day": F.dayofmonth(at)}).write.partitionBy("month", "day").option("sep", "\t").option(
        "header", True).option("compression", "gzip").csv(root)


def read_landing(spark: SparkSession, root: str, month: int, day: int, cols: list[str] | None = None) -> DataFrame:
    """One day of a landing area; the other days' folders are not opened."""
    of_day = read_pings(spark, root).where((F.col("month") == month) & (F.col("day") == day)).drop("month", "day")
    return of_day.select(*cols) if cols else of_day


def read_raw(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with column names stripped; malformed lines are left out and can be had from `malformed`."""
    df = _with_bad_lines(spark, path, schema, header)
    good = df.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    return good.toDF(*[c.strip() for c in good.columns])


def malformed(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """The lines of a CSV that do not fit the schema, with their file and what could be read of them."""
    df = _with_bad_lines(spark, path, schema, header).withColumn("file", F.input_file_name())
    return df.where(F.col(BAD_LINE).isNotNull()).withColumnRenamed(BAD_LINE, "line")


def _with_bad_lines(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    full = f"{schema}, {BAD_LINE} string"
    return spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def read_group(spark: SparkSession, paths: list[str], cols: list[str], skip_unreadable: bool = False) -> DataFrame:
    """Several parquet paths at once. An unreadable file is an error, unless the caller accepts an incomplete result."""
    return spark.read.option("ignoreCorruptFiles", skip_unreadable).parquet(*paths).select(*cols)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_pings(df: DataFrame, path: str, n_groups: int, uid: str = "device_aid") -> None:
    """Partition by user bucket and day. A rebalance splits buckets that are too large for one file task."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    bucketed = df.withColumns({"bucket": F.pmod(F.xxhash64(uid), F.lit(n_groups)), "day": day})
    bucketed.hint("rebalance", "bucket", "day").write.partitionBy("bucket", "day").parquet(path)


def write_batches(df: DataFrame, path: str, n: int, uid: str = "uid", seed: int = 0) -> None:
    """Seeded user batches as gzip parquet."""
    batch = F.pmod(F.xxhash64(uid, F.lit(seed)), F.lit(n))
    df.withColumn("batch", batch).hint("rebalance", "batch").write.partitionBy("batch").option("compression", "gzip").parquet(path)


def scan(spark: SparkSession, table: str, cols: list[str], where: Column | str | None = None, limit: int | None = None) -> DataFrame:
    """Catalog table with projection and filter; `limit` is for looking at a table."""
    df = spark.table(table)
    df = (df if where is None else df.where(where)).select(*cols)
    return df if limit is None else df.limit(limit)


def save(df: DataFrame, table: str, mode: str = "append", path: str | None = None) -> None:
    """Append to or replace a catalog table."""
    writer = df.write.mode("overwrite" if mode == "replace" else mode)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def save_zones(zones: DataFrame, path: str) -> None:
    """Zones with their ring as a vertex array."""
    schemas.require(zones, ["ring"]).write.parquet(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require(spark.read.parquet(path), ["ring"])


def write_features(df: DataFrame, path: str, ring: str = "ring") -> None:
    """GeoJSON polygons, one feature per line; columns other than the ring become properties."""
    closed = F.concat(F.col(ring), F.slice(F.col(ring), 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    props = F.struct(*[c for c in df.columns if c != ring])
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(path)


def read_features(spark: SparkSession, path: str, properties: str, collection: bool = False) -> DataFrame:
    """GeoJSON polygons and multipolygons to properties and a ring; one feature per line, or whole feature collections.

    The ring of a geometry with holes or several parts is one vertex array: it walks every part counter-clockwise and every hole
    clockwise, going back to its first vertex after each. The ways there and back cancel out in areas, overlaps and
    point tests. Other geometries are an error.
    """
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    if collection:
        rows = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path).select(F.inline("features"))
    else:
        rows = spark.read.schema(feature[len("struct<"):-1].replace("properties:", "properties ", 1).replace(",geometry:", ", geometry ", 1)).json(path)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    part = "array<array<array<double>>>"
    parts = (
        F.when(kind == "Polygon", F.array(F.from_json(text, part))).when(kind == "MultiPolygon", F.from_json(text, f"array<{part}>"))
        .otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("null")))))
    )
    return rows.withColumn("_parts", parts).select("properties.*", one_ring(F.col("_parts")).alias("ring"))


def one_ring(parts: Column) -> Column:
    """One vertex array for parts of rings of [x, y] points, each ring closed; the first ring of a part is its outline."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    turned = F.flatten(F.transform(parts, lambda rings: F.transform(rings, lambda ring, i: _turned(F.transform(ring, point), i == 0))))
    first = lambda ring: F.slice(ring, 1, 1)
    walked = F.transform(turned, lambda ring, i: F.when(i == 0, ring).otherwise(F.concat(ring, first(F.get(turned, F.lit(0))))))
    # the last vertex is the first again
    return F.transform(F.array(F.flatten(walked)), lambda line: F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))))[0]


def _turned(ring: Column, outline: Column) -> Column:
    """Outlines counter-clockwise, holes clockwise."""
    n = F.size(ring)
    twice = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
        lambda s, i: s + F.coalesce(F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"], F.lit(0.0)))
    return F.when((twice >= 0) == outline, ring).otherwise(F.reverse(ring))


def read_gtfs(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Text tables of a transit feed."""
    return {n: spark.read.schema(schemas.GTFS[n]).option("header", True).csv(f"{folder.rstrip('/')}/{n}.txt")
            for n in (names or schemas.GTFS)}


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_embeddings(spark: SparkSession, path: str, mapping: str, dim: int = 64) -> DataFrame:
    """Vectors as tab-separated columns d0.. with a node number, and the table from node number to name."""
    cols = ", ".join(f"d{i} double" for i in range(dim))
    vec = spark.read.schema(f"node_id bigint, {cols}").option("sep", "\t").csv(path)
    vec = vec.select("node_id", F.array(*[f"d{i}" for i in range(dim)]).alias("embedding"))
    names = spark.read.schema("node_id bigint, node string").option("header", True).csv(mapping)
    return vec.join(names, "node_id")


def write_embeddings(df: DataFrame, path: str, key: str = "node_id", vec: str = "embedding", dim: int = 64) -> None:
    df.select(key, *[F.get(vec, F.lit(i)).alias(f"d{i}") for i in range(dim)]).write.option("sep", "\t").csv(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
