"""Work on frames whose column names are not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns named by place, which no helper column is, and the new name of each old one."""
    places = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*places.values()), places


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name
