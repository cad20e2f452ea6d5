"""Sources and sinks."""

from sparkwright.sources.io import (load_table, read_csv, read_json, write_csv,
                                    cache_table, infer_types, NA_TOKENS)

__all__ = ["load_table", "read_csv", "read_json", "write_csv", "cache_table",
           "infer_types", "NA_TOKENS"]
