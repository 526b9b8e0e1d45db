"""What plans share with the operators: tables in the shared folder."""

from __future__ import annotations

from ..functions.tables import discard, materialize, new_path, numbered

__all__ = ["discard", "materialize", "new_path", "numbered"]
