"""How a value passes along an edge: value out = factor * value in + plus, by the edge's traverse column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocked edges pass nothing; or one, so that paths may begin at a wait; or nothing blocks.
CAPACITIES = {
    "no_waiting": lambda t: (np.where(t == "Block", 0.0, 1.0), np.zeros(len(t))),
    "waiting_one": lambda t: (np.where(t == "Block", 0.0, 1.0), np.where(t == "Block", 1.0, 0.0)),
    "unbound": lambda t: (np.ones(len(t)), np.zeros(len(t))),
}


def capacity(name: str, traverse: Column, value: Column) -> Column:
    """The same as a column expression."""
    if name == "unbound":
        return value
    return F.when(traverse == "Block", F.lit(1.0 if name == "waiting_one" else 0.0)).when(traverse == "Unbounded", value).otherwise(F.raise_error(F.lit("an edge without traversal")).cast("double"))


def routing_hash(*columns: Column | str) -> Column:
    """A 64-bit hash of columns, as for dealing rows out by hand."""
    return F.xxhash64(*columns)
