"""Relational and blocked-matrix operators."""
