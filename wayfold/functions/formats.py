"""Small text formats: lists of numbers in metadata, and the five entities of XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# XML's entities, in the order in which they are decoded.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def numbers(text: Column, n: int) -> Column:
    """Exactly n finite numbers between commas, as an array; null for anything else."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(p).cast("double")))
    return F.when((F.size(parts) == n) & F.forall(parts, lambda v: v.isNotNull()), parts)


def whole_number(text: Column) -> Column:
    """A number that is all of the text; null for anything else."""
    return F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.cast("int"))


def decoded(text: Column) -> Column:
    """The text with its entities replaced."""
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def encoded(text: Column) -> Column:
    """The text with entities for the signs that XML keeps."""
    for entity, sign in reversed(ENTITIES):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text
