"""Text outputs.  Saving on an existing folder fails unless ``mode`` says otherwise."""

from topicatlas.sinks.text import (
    edit_lines,
    output_name,
    write_category_index,
    write_cluster_report,
    write_edits,
    write_main_categories,
)

__all__ = [
    "edit_lines", "output_name", "write_category_index", "write_cluster_report",
    "write_edits", "write_main_categories",
]
