"""Data model: message, Kafka batch, request, document, catalog.

The typed views of a message stand where it is parsed: the binding view in
``sources/messages.py`` (``resource.data`` as raw JSON text, so that key order
and repeated keys survive), the echo view in ``operators/collate.py`` (opaque
nodes as VARIANT, so that ``to_json`` writes them back as nested JSON). Both
drop unknown properties.
"""

from __future__ import annotations

# Options shared by every message parse: Jackson limits of the reference
# (strings up to 100 MB, nesting up to 2000) and permissive error handling so
# a bad record becomes a NULL (an error row), never a failed job.
JSON_READ_OPTIONS = {
    "mode": "PERMISSIVE",
    "maxNestingDepth": "2000",
    "maxStringLen": str(100 * 1024 * 1024),
}

# Nulls are written out (no inclusion setting in the reference).
JSON_WRITE_OPTIONS = {"ignoreNullFields": "false"}

KAFKA_RECORD_DDL = (
    "struct<topic:string, partition:int, offset:bigint, timestamp:bigint, "
    "timestampType:string, key:string, value:string, headers:array<string>>"
)
KAFKA_BATCH_DDL = (
    "eventSource string, eventSourceArn string, bootstrapServers string, "
    f"records map<string, array<{KAFKA_RECORD_DDL}>>"
)

REQUEST_KEY = ["msg_id", "output_pos", "comp_pos"]
