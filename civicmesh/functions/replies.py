"""Replies of models, read leniently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(reply: Column, field: str, item: str) -> Column:
    """The array of ``item`` (a schema) that a reply's field holds, as an array or as a string with one; missing or null: empty.

    Null for a reply that is no JSON object, and for a field that is neither: such a reply is an error of its own."""
    text = F.get_json_object(reply, f"$.{field}")  # of a string, its content
    empty = F.array().cast(f"array<{item}>")
    held = F.when(text.isNull(), empty).when(F.trim(text).startswith("["), F.from_json(text, f"array<{item}>"))
    return F.when(F.json_object_keys(reply).isNotNull(), held)
