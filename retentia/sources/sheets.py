"""Readers and writers of library sheets, index files, time lists and result tables."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, whose executors are the driver's own, may do without
    one: it gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def read_sheet(spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str = ",", line_breaks: bool = True) -> DataFrame:
    """A sheet with a header, every column as text; an empty one is an error. Files are read in parts, also where cells may hold
    line breaks; of those only one that isn't UTF-8 is one task."""
    options = {"escape": '"', "sep": delimiter, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df = spark.read.csv(path, header=True, multiLine=line_breaks, encoding=encoding, **options)
    if not df.columns:
        raise ValueError(f"no columns in {path}")
    if not line_breaks or encoding.upper().replace("-", "") != "UTF8":
        return df
    return records.read_records(spark, path, df.columns, options)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def stored_table(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored_table wrote and nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_bb_index(spark: SparkSession, path: str) -> DataFrame:
    """name, index, ok of `name,index` lines; a header is optional; an index that is no whole number makes a line wrong."""
    lines = spark.read.csv(path, header=False, schema="name string, idx string").where("name is not null")
    lines = lines.where(~(F.lower(F.trim("name")) == "name") | ~(F.lower(F.trim("idx")) == "index"))
    ok = F.trim("idx").rlike(r"^-?\d+$")
    return lines.select(F.trim("name").alias("name"), F.when(ok, F.trim("idx").cast("long")).alias("index"), ok.alias("ok"))


def usable_bb_index(index: DataFrame) -> DataFrame:
    """The map of an index file: all of it, or nothing if any line is wrong."""
    wrong = index.agg(F.coalesce(F.max((~F.col("ok")).cast("int")), F.lit(0)).alias("wrong"))
    return index.crossJoin(F.broadcast(wrong)).where("wrong = 0").select("name", "index")  # one row


def read_times(spark: SparkSession, path: str, digits: int) -> DataFrame:
    """Distinct rounded times of a list, one a line; blanks and # comments are skipped."""
    text = F.trim("value")
    lines = spark.read.text(path).where((text != "") & ~text.startswith("#"))
    return lines.select(F.round(text.cast("double"), digits).alias("time")).distinct()


#: Characters that a folder's name for a value of the key has as % and their number, and the name for no value, as Spark has them.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Lines of many files that are handed on at a time.
LINES = 20_000


def file_system(path: str):
    """(file system, path in it) of a folder, for use in tasks."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_separately(df: DataFrame, path: str, key: str) -> DataFrame:
    """One folder with a CSV file for each value of the key; gives key and file of each. They are as many as the values, so tasks
    write them themselves, one after another: Spark's writer and its committer take some 30 ms for a file. A file is written
    under a hidden name and then renamed, so a task that is run again does no harm."""
    names = [c for c in df.columns if c != key]
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(names)
    head = header.getvalue()

    def write(batches):
        system, folder = file_system(path)
        attempt = uuid.uuid4().hex

        def written(value, lines):
            own = f"{folder}/{key}={ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value) if value else NO_VALUE}"
            system.create_dir(own)
            with system.open_output_stream(f"{own}/_{attempt}") as out:
                out.write((head + "".join(f"{line}\n" for line in lines)).encode())
            system.move(f"{own}/_{attempt}", f"{own}/part-00000.csv")
            return value, f"{own}/part-00000.csv"

        rows = ((k, line) for b in batches for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        files = (written(k, [line for _, line in own]) for k, own in groupby(rows, key=lambda r: r[0]))
        while some := list(islice(files, LINES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["key", "file"])

    # an empty text and none have one folder
    value = F.when(F.col(key).cast("string") != "", F.col(key).cast("string")).alias("key")
    lines = df.select(value, F.to_csv(F.struct(*names), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))
    lines = lines.repartition(_tasks(df.sparkSession), "key").sortWithinPartitions("key")
    return stored_table(lines.mapInArrow(write, "key string, file string"), f"{path}/_files")


def read_separately(files: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """The rows of the files that write_separately gave, read by tasks: nobody lists the folders, and a task reads many."""

    def read(batches):
        system, _ = file_system(path)

        def lines():
            for b in batches:
                for k, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    with system.open_input_stream(file) as f:
                        yield from ((k, line) for line in f.read().decode().split("\n")[1:-1])

        every = lines()
        while some := list(islice(every, LINES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], [key, "line"])

    dealt = files.repartition(_tasks(files.sparkSession), "file")
    return dealt.mapInArrow(read, f"{key} string, line string").select(key, F.from_csv("line", schema).alias("r")).select(key, "r.*")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
