"""Readers for the text layouts, each with an audit of the rows it could not use."""

from topicatlas.sources.category_index import (
    malformed_category_lines,
    read_category_ips,
    read_class_ips,
)
from topicatlas.sources.edits import (
    malformed_edits,
    read_edits,
    read_edits_with_class,
    read_edits_with_location,
)
from topicatlas.sources.locations import malformed_locations, read_locations
from topicatlas.sources.revisions import (
    malformed_revisions,
    parse_revisions,
    read_revisions,
    read_stanzas,
    well_formed,
)

__all__ = [
    "malformed_category_lines", "malformed_edits", "malformed_locations",
    "malformed_revisions", "parse_revisions", "read_category_ips", "read_class_ips",
    "read_edits", "read_edits_with_class", "read_edits_with_location",
    "read_locations", "read_revisions", "read_stanzas", "well_formed",
]
