"""What rows inherit from the rows that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.middleware import merge_maps


def inherited_meta(parent: Column | str, child: Column | str) -> Column:
    """The parent's meta under the child's."""
    return merge_maps(parent, child)


def inherit(children: DataFrame, parents: DataFrame, on: str = "parent_id", key: str = "id") -> DataFrame:
    """Children with the meta and ancestor of their parents; without a parent they stay as they are."""
    p = parents.select(F.col(key).alias(on), F.col("meta").alias("_meta"), F.col("ancestor").alias("_ancestor"))
    out = children.join(p, on, "left")
    return out.withColumns({"meta": inherited_meta("_meta", "meta"), "ancestor": F.coalesce("_ancestor", "ancestor")}).drop("_meta", "_ancestor").select(*children.columns)


def response_family(family_for_response: Column | str | None = None) -> Column:
    """Family of a response: that which its request names for responses, not the request's own."""
    c = F.lit(None).cast("string") if family_for_response is None else F.col(family_for_response) if isinstance(family_for_response, str) else family_for_response
    return F.coalesce(c, F.lit("Response"))
