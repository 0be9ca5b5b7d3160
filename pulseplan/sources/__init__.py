"""Readers, writers and table schemas."""

from .clustered import cluster_fact
from .csv_tables import load_tables, write_tables
from .footers import footer_tables
from .schema import DATE_COLUMNS, TABLE_SCHEMAS
from .scratch import TEXT_BATCH, shared_folder, stored

__all__ = [
    "DATE_COLUMNS",
    "TABLE_SCHEMAS",
    "TEXT_BATCH",
    "cluster_fact",
    "footer_tables",
    "load_tables",
    "shared_folder",
    "stored",
    "write_tables",
]
