"""Search over matches: optional filters, a checked sort column, and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import scratch

ALL = "All"
SORTABLE = ("ensemble_score", "search_score", "cosine_score", "edit_score", "jaccard_score", "created_at", "item_id", "norm")
DEFAULT_SORT = "ensemble_score"


@dataclass
class Search:
    """What to look for. A filter of 'All' or None does not filter; an unknown sort column falls back to the default."""

    filters: dict[str, str | None] = field(default_factory=dict)
    text: str | None = None
    agreement: int | None = None
    sort_by: str = DEFAULT_SORT
    descending: bool = True
    grouped: bool = True
    page: int = 1
    size: int = 25


def filtered(matches: DataFrame, search: Search) -> DataFrame:
    for column, value in search.filters.items():
        if value not in (None, ALL):
            matches = matches.where(F.col(column) == value)
    return matches.where(F.col("raw_description").ilike(f"%{search.text}%")) if search.text else matches


def found(matches: DataFrame, search: Search) -> DataFrame:
    """The rows in question: filters first, so duplicates count filtered rows alone; agreement after one of each group is taken."""
    column = search.sort_by if search.sort_by in SORTABLE else DEFAULT_SORT
    order = [F.col(column).desc_nulls_last() if search.descending else F.col(column).asc_nulls_first(), F.col("item_id")]
    rows = filtered(matches, search).withColumn("duplicates", F.count(F.lit(1)).over(Window.partitionBy("norm")))
    if search.grouped:
        k = scratch("k")
        rows = rows.withColumn(k, F.row_number().over(Window.partitionBy("norm").orderBy(*order))).where(F.col(k) == 1).drop(k)
    return (rows.where(F.col("level") == search.agreement) if search.agreement else rows).orderBy(*order)


def page_of(rows: DataFrame, page: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows of the page, the page, all rows); a page beyond the last is the last."""
    total = rows.count()
    page = max(1, min(page, -(-total // size)))
    return rows.offset((page - 1) * size).limit(size), page, total
