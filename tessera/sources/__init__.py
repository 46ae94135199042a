"""Readers of rearrangement tables, sheets and groups, and the view of the star schema as a repertoire."""
