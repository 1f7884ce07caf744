"""Relational and graph operators over item tables."""
