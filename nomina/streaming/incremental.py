"""Scanning pages as they arrive: each micro-batch's hits replace those of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nomina.operators.units import page_problems
from nomina.plans.scan import hits
from nomina.sources.files import write_scan


def scan_stream(pages: DataFrame, names: DataFrame, as_of: int, path: str, checkpoint: str, ambiguous: DataFrame | None = None) -> StreamingQuery:
    """A query over streamed pages (file, page_num, text) that stops when all that is there was scanned. A file's pages
    come in one batch (a file source's unit); progress is Structured Streaming's checkpoint, so a restart goes on."""

    def batch(df: DataFrame, _: int) -> None:
        write_scan(hits(df, names, as_of, ambiguous), df, page_problems(df), path, None)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
