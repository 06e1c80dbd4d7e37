"""Suffix-array dedup: repeated byte strings are removed, all but their first occurrence.

Suffixes of the corpus start at content-chosen anchors; sampled splitters range-partition them by leading tokens, buckets
sort locally by multikey quicksort, and what a bucket's border cuts is compared across it by window (see windows.py).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C
from . import windows as W

WIDTH = 100
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept"


def _finish(width: int, carry: list[str], as_text: bool):
    def run(batches):
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            sizes, removed, spans, kept = [], [], [], []
            for i, (lo, hi) in enumerate(W.removed_stretches(batch, width)):
                raw = data[off[i] : off[i + 1]].tobytes()
                sizes.append(len(raw))
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                if len(lo):
                    ends, starts = [0, *hi.tolist()], [*lo.tolist(), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))
                kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.string() if as_text else pa.binary()), *(batch.column(c) for c in carry)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Removes each byte that a `width`-byte string covers which also starts earlier (smaller doc_id, or same document and
    earlier start). docs: doc_id, text, others ignored but for those in `carry`. Returns a row per document: doc_id,
    n_bytes, n_removed, n_spans, kept (the bytes that stay; they may begin inside a UTF-8 character), *carry. With as_text,
    kept is text, without the halves of characters.

    Null text: empty. Null doc_id: before all others. Rows with one doc_id: each its own document, and equal places
    (same id, same start) are no earlier than each other, so exact repeats of a row keep the same bytes. Texts under
    `width` bytes keep everything. No documents: no rows.
    """
    spec = W.Spec(words=False, width=width, spread=max(1, width * 64 // 100), any_place=False)
    schema = StructType.fromDDL(SCHEMA + (" string" if as_text else " binary"))
    for c in carry:
        schema = schema.add(docs.schema[c])
    return W.repeated(docs, spec, W.suffix_order_resolver(width), _finish(width, list(carry), as_text), schema, list(carry))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """A table like documents with repeated bytes gone from its texts: a character that is cut in part goes, and so does a
    document of which only white space stays; n_chars, where there is one, is that of the new text. Untouched documents stay
    as they are, but for null text, which becomes empty.

    Rows with one id are each a document, so all but the least of different places go, and exact repeats of a row keep the
    same bytes. A null doc_id is before all others. Columns besides these are passed on. No documents: no rows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    source = docs.select("doc_id", "text", F.struct(*rest).alias("_rest")) if rest else docs.select("doc_id", "text")
    kept = remove_repeated_bytes(source, carry=("_rest",) if rest else (), as_text=True)
    out = kept.withColumnRenamed("kept", "text").where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(columns.get(c, F.col("_rest").getField(c) if c in rest else F.col(c)).alias(c) for c in docs.columns))
