"""The questions end to end, composed of the operators."""

from topicatlas.plans.index import (
    build_coded_index,
    build_index,
    locate_categories,
    prepare_edits,
    prepare_locations,
)
from topicatlas.plans.regions import Regions, find_regions

__all__ = ["Regions", "build_coded_index", "build_index", "find_regions", "locate_categories",
           "prepare_edits", "prepare_locations"]
