"""Task graphs and versions: small plans, on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import C, col


class CycleError(ValueError):
    """Tasks that wait for each other."""


def depths(needs: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """The depth of each task: 0 without needs, else one more than its deepest need."""
    unknown = {n for of in needs.values() for n in of} - set(needs)
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    out: dict[str, int] = {}
    left = {task: set(of) for task, of in needs.items()}
    while left:
        ready = [task for task, of in left.items() if of <= out.keys()]
        if not ready:
            raise CycleError(f"a cycle among {sorted(left)}")
        out |= {task: 1 + max((out[n] for n in needs[task]), default=-1) for task in ready}
        for task in ready:
            del left[task]
    return out


def order(needs: Mapping[str, Sequence[str]]) -> list[str]:
    """Tasks so that each comes after its needs; of equal depth as given."""
    depth = depths(needs)
    return sorted(needs, key=depth.__getitem__)


def ready(needs: Mapping[str, Sequence[str]], done: set[str]) -> list[str]:
    return [task for task, of in needs.items() if task not in done and set(of) <= done]


def version_key(c: C) -> Column:
    """A semantic version as an array of numbers, which sorts by release; null where it is none."""
    found = F.regexp_extract(col(c), r"^v?(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))
