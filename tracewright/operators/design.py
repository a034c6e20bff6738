"""Test plans: pairwise covering rows of factors, and variants of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.catalogues import pair_with


def covering_rows(factors: dict[str, list[str]]) -> list[dict[str, str]]:
    """Rows that cover every pair of levels of any two factors, chosen greedily.

    The factors of a plan are a handful, and each row depends on what those before left uncovered, so
    this runs on the driver; its input is a catalogue, never data.
    """
    names = list(factors)
    open_pairs = {(a, x, b, y) for i, a in enumerate(names) for b in names[i + 1 :] for x in factors[a] for y in factors[b]}
    rows: list[dict[str, str]] = []
    while open_pairs:
        a, x, b, y = min(open_pairs)
        row = {a: x, b: y}
        for name in names:
            if name not in row:
                gain = {v: sum(((n, w, name, v) if names.index(n) < names.index(name) else (name, v, n, w)) in open_pairs for n, w in row.items()) for v in factors[name]}
                row[name] = max(factors[name], key=lambda v: gain[v])
        rows.append({n: row[n] for n in names})
        open_pairs -= {(p, row[p], q, row[q]) for i, p in enumerate(names) for q in names[i + 1 :]}
    return rows


def level_pairs(rows: DataFrame, factors: list[str]) -> DataFrame:
    """``factor_a, level_a, factor_b, level_b, n``: how often each pair of levels occurs in the rows."""
    pairs = [F.struct(F.lit(a).alias("factor_a"), F.col(a).alias("level_a"), F.lit(b).alias("factor_b"), F.col(b).alias("level_b")) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("factor_a", "level_a", "factor_b", "level_b").agg(F.count("*").alias("n"))


def variants(scenarios: DataFrame, rows: DataFrame, adverse: dict[str, str]) -> DataFrame:
    """Every scenario with every covering row, and blocking ones with the adverse row as well, unless it is there already.

    ``scenarios``: ``scenario_id, blocking``.
    """
    out = pair_with(scenarios, rows).withColumn("reason", F.lit("pairwise"))
    if rows.filter(" AND ".join(f"{k} = '{v}'" for k, v in adverse.items())).isEmpty():
        hard = scenarios.filter("blocking").select("*", *[F.lit(v).alias(k) for k, v in adverse.items()], F.lit("adverse").alias("reason"))
        out = out.unionByName(hard)
    return out
