"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

from paperloom.sources.scratch import scratch_path as new_path
from paperloom.sources.scratch import written

__all__ = ["new_path", "written"]
