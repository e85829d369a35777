"""Reading corpora, manifests and dataset tables; writing results."""

from corpusprov.sources.readers import (
    list_files,
    read_corpus,
    read_xz_lines,
    sample_rows,
    scan_tables,
    url_columns,
)
from corpusprov.sources.rules import (
    ExtractionRule,
    extract_batch,
    extract_urls,
    find_rule,
    rules_frame,
)
from corpusprov.sources.sinks import (
    append_results,
    compact,
    csv_to_parquet,
    current_results,
    read_results,
    write_batches,
    write_csv,
    write_url_batch,
)
from corpusprov.sources.tables import dataset_slice, host_urls, read_datasets, tagged

__all__ = [
    "list_files", "read_corpus", "read_xz_lines", "sample_rows", "scan_tables", "url_columns",
    "ExtractionRule", "extract_batch", "extract_urls", "find_rule", "rules_frame",
    "append_results", "compact", "csv_to_parquet", "current_results", "read_results", "write_batches", "write_csv", "write_url_batch",
    "dataset_slice", "host_urls", "read_datasets", "tagged",
]
