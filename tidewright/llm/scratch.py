"""Tables that cut lineage, as in ``tidewright.stored``."""

from __future__ import annotations

from tidewright.stored import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
