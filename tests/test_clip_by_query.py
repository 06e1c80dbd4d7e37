"""Queries that start from the clipped baseline against their SQL, on traces of 60 x sf0.1 in which a level is exactly the cutoff."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from retentia import registry

#: Counts by month (0: none). Sums in numpy's own order clip other values of these, which changes peaks or a baseline.
TRACES = [
    "0324404131100112100005400121012101230001002043024421100714120001102010130120032112",  # peaks
    "104300000140211310024010101210110411304031231120001310000230210004100111323131113",  # peaks
    "502222245410111024150205033221021253021054341136402101221304011210212501102211022",  # peaks
    "0334112120200254221221811310340030322122114012236304112221310220102410041111202122",  # peaks
    "421003342210320102003134224127405320110110110740410225111101111071111240202513152",  # peaks
    "0302010102130132202000022000012212012200362021003110021320112121011120102020102002",  # peaks
    "3002040300010203001046020420001011212011020321021100024302211411201012142011222022",  # baseline
    "0000020311000022202000031200031312102002210130100011010221101000121200422421120212",  # baseline
    "1126102031421151120113213120222712057024011324213052112215121034412210202020042012",  # baseline
]
QUERIES = [
    "a21_plot_baseline_mu",
    "a21_plot_dynamic_range",
    "a21_plot_peak_count",
    "a21_plot_snr_excess",
    "a21_plot_snr_ratio",
    "p21_quality_filter",
    "p22_truncation_rescue",
    "w05_rolling_baseline",
    "w07_peak_numbering",
    "s08_metrics_sink",
    "s09_signal_sink",
    "s10_peak_sink",
]


@pytest.fixture(scope="module")
def on_the_cutoff(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cutoff")
    rows = []
    for k, trace in enumerate(TRACES):
        for month, count in enumerate(trace):
            rows += [(len(rows), k % 4, k // 4, 1, 1.0, datetime(1995 + month // 12, month % 12 + 1, 5))] * int(count)
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.timestamp("us")]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names), folder / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(range(4), pa.int64())}), folder / "supplier.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_those_of_the_sql(spark, on_the_cutoff, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{on_the_cutoff}/{table}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, on_the_cutoff).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
