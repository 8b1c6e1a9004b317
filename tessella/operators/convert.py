"""Hooks for external converters (UDF01, UDF02, UDF05, UDF08, WIN05): the dispatch, order and status, not the conversion itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Converter = Callable[[str, bytes], str | None]


def convert(files: DataFrame, strategies: list[tuple[str, Converter]], skip: tuple[str, ...] = (".doc",)) -> DataFrame:
    """path, converter, markdown, error: the first strategy that gives text wins.

    The whole chain is one function, as Spark doesn't promise to leave later UDFs uncalled. A converter is loaded once per
    task if it is a factory's result; one that raises leaves its message. Files of `skip` aren't tried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = text = None
                errors = []
                if not path.lower().endswith(skip):
                    for name, f in strategies:
                        try:
                            text = f(path, content or b"")
                        except Exception as e:  # noqa: BLE001  converters fail in any way
                            errors.append(f"{name}: {e}")
                        if text:
                            break
                rows.append((path, name if text else None, text or None, "; ".join(errors) or None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "converter", "markdown", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, converter string, markdown string, error string")


#: fixed values: ways from office files to pages, in order, and their time limits in seconds; all are external programs
OFFICE = (("soffice", 120), ("mammoth+chrome", 60), ("docx2pdf", None))


def office_strategy(soffice: Column, chrome: Column, word: Column) -> Column:
    """UDF05, WIN05: struct(strategy, seconds): the first way that is there, or none."""
    out = F.struct(F.lit("none").alias("strategy"), F.lit(None).cast("long").alias("seconds"))
    for there, (name, seconds) in reversed(list(zip((soffice, chrome, word), OFFICE))):
        out = F.when(there, F.struct(F.lit(name).alias("strategy"), F.lit(seconds).cast("long").alias("seconds"))).otherwise(out)
    return out


def page_count(*counts: Column) -> Column:
    """UDF08, WIN05: the first count of at least one page that a reader gives, else one page. The readers are external; their counts are columns."""
    return F.coalesce(*[F.when(c > 0, c) for c in counts], F.lit(1))


def with_status(converted: DataFrame, images: DataFrame) -> DataFrame:
    """PRJ04 over conversions: path, status."""
    from tessella.operators.ingest import document_status

    rows = converted.join(images.select("path", "images"), "path", "left")
    return rows.select("path", document_status(F.col("markdown").isNotNull(), F.coalesce(F.size("images"), F.lit(0)) > 0).alias("status"))
