from tenderflow.sources.staging import stage, staging_root
from tenderflow.sources.tables import (
    append_rows,
    date_predicates,
    jdbc_reader,
    load_tables,
    parquet_reader,
    refresh,
    residue_predicates,
    write_tables,
)

__all__ = [
    "append_rows", "date_predicates", "jdbc_reader", "load_tables", "parquet_reader", "refresh",
    "residue_predicates", "stage", "staging_root", "write_tables",
]
