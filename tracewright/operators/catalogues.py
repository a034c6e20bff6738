"""Small tables that go with every row: the assertions, limits and texts of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(value: object, kind: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def pair_with(rows: DataFrame, catalogue: DataFrame, most: int = 5_000) -> DataFrame:
    """Each row with each row of the catalogue, whose size is checked: over ``most`` rows it is refused.

    The catalogue becomes part of the plan, so no row moves.
    """
    found = catalogue.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a catalogue may have {most} rows at most")
    kinds = dict(catalogue.dtypes)
    whole = "array<struct<" + ", ".join(f"`{c}`: {k}" for c, k in kinds.items()) + ">>"
    entries = F.array(*[F.struct(*[_literal(r[c], k).alias(c) for c, k in kinds.items()]) for r in found]).cast(whole)
    return rows.withColumn("_c", F.explode(entries)).select(*rows.columns, *[F.col(f"_c.`{c}`") for c in kinds])
