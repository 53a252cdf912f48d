"""Intermediate tables that outlive lost executors."""

from ferrule.sources.scratch import materialise

__all__ = ["materialise"]
