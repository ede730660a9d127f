"""Operators on pages, their node tables, catalogs, work lists and serving."""
