"""Digests of rows in an order, as a stream."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(rows: DataFrame, text: str, order: list[str], by: list[str] = (), join: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """``by, n, sha256`` of the texts of each group, joined in an order.

    A group's rows are sorted by Spark, which spills, and run through the hash
    one Arrow batch after the other, so no row or list holds a group.  A digest
    is a chain, so a group is read by one task; different groups by different
    ones.  Null texts are an error.  Without ``by`` all rows are one group; no
    rows give no row.
    """
    by = list(by)
    keys, kept = [f"_k{i}" for i in range(len(order))], rows.select(*by, F.col(text).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(order)))
    whole = kept.repartition(*by) if by else kept.repartition(1)
    sorted_rows = whole.sortWithinPartitions(*by, *keys).select(*by, "_text")
    schema = sorted_rows.select(*by).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    width = len(by)

    def run(batches):
        last, h, n = None, None, 0
        out: list[tuple] = []

        def closed():
            h.update(tail.encode())
            out.append((*last, n, h.hexdigest()))

        fields = None
        for batch in batches:
            fields = batch.schema
            for row in zip(*(batch.column(i).to_pylist() for i in range(width + 1))):
                if last is None or row[:width] != last:
                    if last is not None:
                        closed()
                    last, h, n = row[:width], hashlib.sha256(head.encode()), 0
                elif n:
                    h.update(join.encode())
                if row[width] is None:
                    raise ValueError("a text is missing")
                h.update(row[width].encode())
                n += 1
        if last is not None:
            closed()
            types = [*(fields.field(i).type for i in range(width)), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], [*by, "n", "sha256"])

    return sorted_rows.mapInArrow(run, ", ".join([*([kinds] if by else []), "n long", "sha256 string"]))
