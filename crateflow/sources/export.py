"""Exports: flat and nested files of the library, written in parallel unless one file is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.functions.text import iso


def liked_rows(tracks: DataFrame, liked: DataFrame) -> DataFrame:
    """Likes, newest first (nulls last), times as ISO text, null as empty text."""
    rows = liked.join(tracks, "track_id").orderBy(F.desc_nulls_last("added_at"), "track_id")
    return rows.select(F.col("track_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("isrc", F.lit("")).alias("isrc"), iso(F.col("added_at")).alias("added_at"))


def playlist_rows(playlists: DataFrame, items: DataFrame, tracks: DataFrame) -> DataFrame:
    """A row per item, current or not; an unknown track is an empty name."""
    rows = items.join(playlists.select("playlist_id", F.col("name").alias("playlist")), "playlist_id").join(tracks.select("track_id", "name"), "track_id", "left")
    return rows.select("playlist_id", "playlist", "position", "track_id", F.coalesce("name", F.lit("")).alias("name"))


def playlists_nested(rows: DataFrame) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("position", "track_id", "name"))), lambda i: i)
    return rows.groupBy("playlist_id", "playlist").agg(items.alias("items"))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


#: What a connection of each kind of database is told first.
SESSIONS = {
    "sqlite": "PRAGMA journal_mode=WAL; PRAGMA busy_timeout=30000; PRAGMA foreign_keys=ON",
    "postgresql": "SET TIME ZONE 'UTC'",
    "mysql": "SET SESSION time_zone = '+00:00'",
}


def connection(url: str, **options: str) -> dict[str, str]:
    """Options of a JDBC connection: the URL, what its kind of database is told first, and the caller's own, which win."""
    kind = url.split(":")[1]
    first = {"sessionInitStatement": SESSIONS[kind]} if kind in SESSIONS else {}
    return {"url": url, **first, **options}


def _quoted(spark: SparkSession, url: str, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, where: str | None = None, **options: str) -> DataFrame:
    """A table of a database, by `partitions` connections, each with a range of a numeric, date or timestamp key.

    The key's least and largest values are asked of the database first. where: a condition in its SQL, which the database applies to
    bounds and rows. Rows without a key are read with the first range. Without a key, or without rows, one connection reads.
    """
    asked = connection(url, **options)
    source = f"(select * from {table} where {where}) picked" if where else table
    if key is None:
        return spark.read.format("jdbc").options(**asked, dbtable=source).load()
    name = _quoted(spark, url, key)
    low, high = (_quoted(spark, url, x) for x in ("low", "high"))
    ends = f"(select min({name}) as {low}, max({name}) as {high} from {source if where else table}) ends"
    least, most = spark.read.format("jdbc").options(**asked, dbtable=ends).load().first()
    if least is None:
        return spark.read.format("jdbc").options(**asked, dbtable=source).load()
    return spark.read.format("jdbc").options(**asked, dbtable=source, partitionColumn=key, lowerBound=str(least), upperBound=str(most), numPartitions=str(partitions)).load()


def copy_table(spark: SparkSession, source_url: str, target_url: str, table: str, batch: int = 2000, key: str | None = None, partitions: int = 8, where: str | None = None, **options: str) -> tuple[int, int]:
    """Copies a table between databases by JDBC, replacing the target's rows; (rows read, rows in the target then).

    By key as in read_table(), with as many connections to the target as to the source. Counts are asked of the databases.
    """
    rows = read_table(spark, source_url, table, key, partitions, where, **options)
    rows.write.format("jdbc").mode("overwrite").options(**connection(target_url, **options), dbtable=table, truncate="true", batchsize=str(batch), numPartitions=str(partitions)).save()
    return row_count(spark, source_url, table, where, **options), row_count(spark, target_url, table, **options)


def row_count(spark: SparkSession, url: str, table: str, where: str | None = None, **options: str) -> int:
    """How many rows a table of a database has, counted there."""
    n = _quoted(spark, url, "n")
    query = f"(select count(*) as {n} from {table}{f' where {where}' if where else ''}) counted"
    return int(spark.read.format("jdbc").options(**connection(url, **options), dbtable=query).load().first()[0])


def snapshot_document(snapshot_id: str, liked: DataFrame, playlists: DataFrame, items: DataFrame) -> DataFrame:
    """A JSON line per row of a snapshot: kind (liked, playlist, item) and document. Written as one folder, read back by kind."""
    parts = []
    for kind, rows in (("liked", liked), ("playlist", playlists), ("item", items)):
        some = rows.where(F.col("snapshot_id") == snapshot_id)
        parts.append(some.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in rows.columns if c != "snapshot_id"])).alias("document")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
