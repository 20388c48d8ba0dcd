from batchlens.sources.shared import discard, run_folder, settle, stored, stored_in_lots
from batchlens.sources.tables import (
    describe_schema,
    preview,
    read_batches,
    table_shape,
    write_mappings,
    write_table,
)

__all__ = [
    "describe_schema",
    "discard",
    "preview",
    "read_batches",
    "run_folder",
    "settle",
    "stored",
    "stored_in_lots",
    "table_shape",
    "write_mappings",
    "write_table",
]
