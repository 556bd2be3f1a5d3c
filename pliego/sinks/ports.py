"""U3: the ``save`` port of a user's own document store (``getTemplate`` is U2's
``register_template_source``).

A store is a Python Data Source with a writer: tasks write rows and return what
they wrote, ``commit`` or ``abort`` gets all their messages, once, on the driver.
A stream batch saves its documents to the registered stores before its ledger row
is written. A store is told the batch and the attempt, so that a batch that
comes again can replace what an attempt left that was never committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource

DOCUMENT_STORES: dict[str, tuple[type[DataSource], dict[str, str]]] = {}


def register_document_store(name: str, source: type[DataSource], options: dict[str, str] | None = None) -> None:
    """Plug a store under ``name``; a second registration of the name replaces the first."""
    DOCUMENT_STORES[name] = (source, dict(options or {}))


def unregister_document_store(name: str) -> None:
    DOCUMENT_STORES.pop(name, None)


def save(documents: DataFrame, batch_id: int, attempt: str, names: list[str] | None = None) -> None:
    """Write ``documents`` to the stores ``names`` (all registered ones), each in one
    job that ends with the store's commit or, if a task failed for good, its abort."""
    for name in names or list(DOCUMENT_STORES):
        source, options = DOCUMENT_STORES[name]
        documents.sparkSession.dataSource.register(source)
        writer = documents.write.format(source.name()).mode("append").options(**options)
        writer.option("batch_id", str(batch_id)).option("attempt", attempt).save()
