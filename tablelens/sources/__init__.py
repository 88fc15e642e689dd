from tablelens.sources.tables import load_table, normalise, normalise_names, read_csv, preview

__all__ = ["load_table", "normalise", "normalise_names", "read_csv", "preview"]
