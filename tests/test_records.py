"""Sheets with line breaks in cells, read in parts, against Spark's own reader of whole files."""

import random

import pytest

from retentia.sources import records as R
from retentia.sources import sheets as S

WHOLE = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", 1)

    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)

    yield set_
    for k, v in old.items():
        spark.conf.set(k, v)


def sheet(seed: int, rows: int) -> str:
    rng = random.Random(seed)
    pieces = ["a", "é", ",", "\n", '""', " ", "long text " * 3, "\n\n", "7:1;2"]
    out = ['id,"a, ""name""",cell']
    for i in range(rows):
        cells = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(2)]
        out.append(",".join([str(i), *(f'"{c}"' if c or rng.random() < 0.5 else "" for c in cells)]))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(out) + ("\n" if seed % 2 else "")


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("block", [64, 97, 1000, 10**6])
def test_equal_to_whole_files(spark, small_blocks, tmp_path, block):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(sheet(i, 120))
    theirs = spark.read.csv(str(tmp_path), **WHOLE)
    small_blocks(block)
    ours = S.read_sheet(spark, str(tmp_path))
    assert ours.columns == theirs.columns
    assert rows_of(ours) == rows_of(theirs)
    if block < 1000:
        assert R.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_without_broadcast_and_over_batches(spark, small_blocks, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(sheet(5, 300))
    theirs = rows_of(spark.read.csv(str(tmp_path), **WHOLE))
    monkeypatch.setattr(R, "BROADCAST_BLOCKS", 0)
    small_blocks(500)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows_of(S.read_sheet(spark, str(tmp_path))) == theirs
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_odd_files(spark, small_blocks, tmp_path):
    small_blocks(16)
    (tmp_path / "head.csv").write_text("id,cell\n")
    assert S.read_sheet(spark, f"{tmp_path}/head.csv").collect() == []
    (tmp_path / "crlf.csv").write_bytes(b'id,cell\r\n1,"x\r\ny"\r\n\r\n2,\r\n3\r\n4,z,more\r\n')
    assert [tuple(r) for r in S.read_sheet(spark, f"{tmp_path}/crlf.csv").orderBy("id").collect()] == [("1", "x\r\ny"), ("2", None), ("3", None), ("4", "z")]
    (tmp_path / "open.csv").write_text('id,cell\n1,x\n2,"never\nclosed\n3,y\n')
    assert S.read_sheet(spark, f"{tmp_path}/open.csv").count() == 2
