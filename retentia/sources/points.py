"""A library's points as a bucketed table in which compounds can be written anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "compound_id string, channel string, time double, count double, row_no long, place int, revision long"


@dataclass(frozen=True)
class PointsStore:
    """Points in buckets by compound_id. A compound written again is appended under a higher revision, to its bucket alone, and
    readers keep each compound's latest revision: nothing that stands is rewritten, and a job that fails halfway leaves the
    earlier points in force. Latest revisions, traces and joins by compound read the buckets without an exchange.

    What is written names compounds by compound_id; a null one is no compound and is left out. A compound that comes without
    points (a null or empty array) has none afterwards: a row without a time says so."""

    spark: SparkSession
    name: str

    @staticmethod
    def create(spark: SparkSession, name: str, path: str, buckets: int | None = None) -> PointsStore:
        """An empty store of a name in the session's catalog. buckets: as many as shuffles have partitions, unless given."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        empty = spark.createDataFrame([], SCHEMA)
        empty.write.format("parquet").option("path", path).bucketBy(n, "compound_id").saveAsTable(name)
        return PointsStore(spark, name)

    def buckets(self) -> int:
        found = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
        return int(found.data_type)

    def write(self, rows: DataFrame, revision: int) -> None:
        """Replaces the compounds of rows (compound_id, row_no, points: as clean_points makes them). A compound may stand in
        several rows; points of one time and channel then go by row_no and place in the cell. Revisions must rise from write
        to write, and one number may be used again only by a write that is repeated as a whole after a failure."""
        p = rows.where("compound_id is not null").select("compound_id", "row_no", F.explode_outer("points").alias("p"))
        p = p.select("compound_id", "row_no", F.col("p.time").alias("time"), F.col("p.place").alias("place"), F.explode_outer("p.counts").alias("c"))
        out = p.select("compound_id", "c.channel", "time", "c.count", F.col("row_no").cast("long").alias("row_no"), "place", F.lit(revision).cast("long").alias("revision"))
        n = self.buckets()
        # One file for each bucket: tasks of the write are the buckets.
        out.repartition(n, "compound_id").write.mode("append").format("parquet").bucketBy(n, "compound_id").saveAsTable(self.name)

    def points(self) -> DataFrame:
        """compound_id, channel, time, count, row_no, place of the latest revisions; repeated times of a channel all stand."""
        latest = F.max("revision").over(Window.partitionBy("compound_id"))
        rows = self.spark.table(self.name).withColumn("_latest", latest)
        return rows.where("revision = _latest and time is not null").drop("revision", "_latest")

    def traces(self) -> DataFrame:
        """compound_id, channel, rt, y in order of time; of several counts at one time the last one wins, by row and place in
        its cell."""
        from ..operators.parse import traces

        return traces(self.points(), order=("row_no", "place"))

    def compact(self, name: str, path: str) -> PointsStore:
        """The latest revisions as a store of another name: one write of all points, for when many revisions stand."""
        points = self.points().withColumn("revision", F.lit(0).cast("long"))
        n = self.buckets()
        points.write.format("parquet").option("path", path).bucketBy(n, "compound_id").saveAsTable(name)
        return PointsStore(self.spark, name)
