"""Intermediate tables of the corpus operators: see bytefold.sources.workspace."""

from bytefold.sources.workspace import drop, folder, keep, release, within

__all__ = ["drop", "folder", "keep", "release", "within"]
