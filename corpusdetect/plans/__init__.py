"""Physical building blocks: materialisation, sized joins, skew-safe order."""

from .joins import fits_broadcast, lookup_join
from .ranking import global_index, range_buckets
from .storage import (
    by_key,
    drop_scratch,
    empty_folder,
    held,
    materialize,
    parts_for,
    scratch_path,
    scratch_scope,
    shared_folder,
    shuffles_dropped,
    slices,
    spread_small,
)

__all__ = [
    "by_key",
    "drop_scratch",
    "empty_folder",
    "fits_broadcast",
    "global_index",
    "held",
    "lookup_join",
    "materialize",
    "range_buckets",
    "parts_for",
    "scratch_path",
    "scratch_scope",
    "shared_folder",
    "shuffles_dropped",
    "slices",
    "spread_small",
]
