"""Sources and sinks of collatio."""

from collatio.sources.csv import read_csv, write_csv, write_table
from collatio.sources.ground_truth import alto_pages, attach_images, find_images, hash_files, png_sizes, read_alto, scan_pairs, write_files
from collatio.sources.predictions import build_table, controlled_variants, join_manifest, load_predictions
from collatio.sources.tables import checkpoint_dir, cut_lineage, table

__all__ = [
    "alto_pages", "attach_images", "build_table", "checkpoint_dir", "controlled_variants", "cut_lineage", "find_images", "hash_files", "join_manifest", "load_predictions",
    "png_sizes", "read_alto", "read_csv", "scan_pairs", "table", "write_csv", "write_files", "write_table",
]
