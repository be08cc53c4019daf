"""Shared-folder helpers of the library, as the text operators use them."""

from __future__ import annotations

from tessera.storage import discard, fresh_path, materialize, remove_path, shared_dir, shuffle_width, spread_join

__all__ = ["discard", "fresh_path", "materialize", "remove_path", "shared_dir", "shuffle_width", "spread_join"]
