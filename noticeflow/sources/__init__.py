"""Landed data to notices: files, payload tables, captured pages; and what is written out."""
