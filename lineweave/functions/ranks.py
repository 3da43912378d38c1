"""Rank labels: the first upper bound that a value does not exceed names its rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound, label.
FILE_SIZE = ((200, "1 to 200"), (600, "201 to 600"), (1800, "601 to 1800"), (None, "1800+"))
COMMENT_DENSITY = ((0, "0%"), (4, "> 25%"), (10, "> 10%"), (20, "> 5%"), (None, "< 5%"))
IMPORTS = ((4, "0 to 4"), (10, "5 to 10"), (20, "10 to 20"), (None, "21+"))
ROUTINE_SIZE = ((50, "1 to 50"), (100, "51 to 100"), (200, "101 to 200"), (None, "200+"))
COMPLEXITY = ((6, "1 to 6"), (14, "7 to 14"), (30, "15 to 30"), (None, "31+"))
NESTING = ((2, "0 to 2"), (5, "3 to 5"), (None, "6+"))
FILES_IN_FOLDER = ((10, "1 to 10"), (30, "11 to 30"), (100, "31 to 100"), (None, "100+"))


def rank(value: Column, table: tuple) -> Column:
    """The label of a value; '' for a null value."""
    out = F.when(value.isNull(), "")
    for bound, label in table[:-1]:
        out = out.when(value <= bound, label)
    return out.otherwise(table[-1][1])
