"""A CSV file for each value of a key: the rows come back, Spark's own reader finds them, and many files take little time."""

import time

from retentia.sources import sheets

SCHEMA = "key string, name string, n int, x double"
OTHERS = "name string, n int, x double"


def test_rows_come_back(spark, tmp_path):
    keys = ["B1-B2", "a/b", "50%", "x=y", "[q]", "d:e", "ä", "_h"]
    rows = [(k, name, i, i / 3) for k in keys for i, name in enumerate(["a,b", 'say "so"', " wide ", None])] + [(None, "none", 7, None)]
    path = f"{tmp_path}/out"
    files = sheets.write_separately(spark.createDataFrame(rows, SCHEMA), path, "key")
    assert files.count() == files.select("file").distinct().count() == len(keys) + 1
    assert {tuple(r) for r in sheets.read_separately(files, path, "key", OTHERS).collect()} == set(rows)
    found = spark.read.csv(path, header=True, schema=OTHERS, escape="\\").select("key", "name", "n", "x")
    assert {tuple(r) for r in found.collect()} == set(rows)


def test_many_files_take_less_than_half_of_what_the_writer_of_partitions_takes(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('k', id % 1500) as key", "cast(id as string) as name", "cast(id as int) as n", "id / 7 as x").cache()
    rows.count()
    seconds = []
    for write in (lambda path: sheets.write_separately(rows, path, "key"), lambda path: rows.repartition("key").write.partitionBy("key").csv(path, header=True)):
        write(f"{tmp_path}/once-{len(seconds)}-{len(list(tmp_path.iterdir()))}")
        start = time.monotonic()
        write(f"{tmp_path}/timed-{len(seconds)}")
        seconds.append(time.monotonic() - start)
    assert 2 * seconds[0] < seconds[1], seconds
