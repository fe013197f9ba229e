"""Registered queries over the given tables."""

from . import audit, books, invoices, io, rest, shipments, texts, waybills
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "audit", "books", "invoices", "io", "rest", "shipments", "texts", "waybills"]
