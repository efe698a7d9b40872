"""Registered queries; importing any of them registers all."""

from tidemark.plans import registry

__all__ = ["registry"]
