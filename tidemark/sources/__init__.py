from tidemark.sources.tables import ensure_folders, read_csv, read_table, write_csv, write_manifest, write_table

__all__ = ["ensure_folders", "read_csv", "read_table", "write_csv", "write_manifest", "write_table"]
