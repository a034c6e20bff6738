"""Joins on keys of which a few may have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are dealt to several tasks; there are fewer of them than this number.
SHARE = 1_000
#: Tasks that the rows of such a key are dealt to.
SALTS = 64


def join_heavy(rows: DataFrame, found: DataFrame, key: str, weight: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has each key once and how many rows have it (``weight``).

    Rows of a key with over a thousandth of all of them are dealt to ``SALTS`` tasks by their ``spread`` columns, and the entry of the key goes to each of
    these; which keys these are is a broadcast of fewer than ``SHARE``. All others meet by their key. There is one exchange of the rows.
    ``weight`` is left out of the result; ``found`` is read repeatedly and should be a written table. ``how`` is ``inner`` or ``left``.
    """
    total = found.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * SHARE > total
    marks = F.broadcast(found.filter(heavy).select(key, F.lit(True).alias("_heavy")))
    marked = rows.join(marks, key, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salts = F.when(heavy, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = found.withColumn("_salt", F.explode(salts)).drop(weight)
    return marked.join(copies, [key, "_salt"], how).drop("_heavy", "_salt")
