"""Candidates to admitted triples: schema check, ordered criteria, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import NUMBER_WORDS, folded

#: Phrases that make a quote a prohibition, and words that make it a denial of any kind.
MODAL_DENIAL = r"(?i)\b(?:must not|may not|shall not|should not|cannot|can not|must never|may never|is not permitted|are not permitted|is prohibited|are prohibited|is forbidden|are forbidden|do not|does not|never)\b"
ANY_DENIAL = r"(?i)\b(?:no|not|never|without|prohibit(?:s|ed)?|forbid(?:s|den)?|disallow(?:s|ed)?|refrain|avoid|decline|refuse)\b|n't\b"
#: Criteria in the order in which they are tried.
CRITERIA = ("schema", "empty", "citation", "quote", "polarity", "value")


def schema_problem(c: str, r: str) -> Column:
    """What is wrong with a candidate (alias ``c``) by its relation (alias ``r``, nulls if unknown); null if nothing."""
    relation, tail_type = F.col(f"{r}.name"), F.col(f"{c}.tail_type")
    kind, tail = F.col(f"{r}.literal_type"), F.lower(F.trim(F.col(f"{c}.tail")))
    literal = F.when(kind == "int", tail.try_cast("bigint").isNotNull()).when(kind == "bool", tail.isin("true", "false")).when(kind == "enum", F.array_contains(f"{r}.enum", F.col(f"{c}.tail"))).otherwise(F.lit(True))
    return (
        F.when(relation.isNull(), "unknown relation")
        .when(~F.array_contains(f"{r}.domain", F.col(f"{c}.head_type")), "head type out of domain")
        .when(kind.isNotNull() & tail_type.isNotNull(), "literal expected")
        .when(kind.isNull() & tail_type.isNull(), "entity expected")
        .when(kind.isNull() & ~F.array_contains(f"{r}.range", tail_type), "tail type out of range")
        .when(kind.isNotNull() & ~F.coalesce(literal, F.lit(False)), "literal of another type")
    )


def check_schema(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates with ``problem``. ``relations``: ``name, domain, range, literal_type, enum, polarity``."""
    c, r = candidates.alias("c"), relations.alias("r")
    return c.join(r, F.col("c.relation") == F.col("r.name"), "left").select("c.*", F.col("r.polarity").alias("polarity"), F.col("r.literal_type").alias("literal_type"), schema_problem("c", "r").alias("problem"))


def admit(candidates: DataFrame, relations: DataFrame, passages: DataFrame, shortest_quote: int = 8) -> DataFrame:
    """Candidates with ``criterion``, the first that they fail (null: admitted), and ``start`` of the quote.

    ``candidates``: ``head, head_type, relation, tail, tail_type, passage_id, quote``; ``passages``: ``passage_id, text``.
    All criteria are one ordered expression over one pass.
    """
    checked = check_schema(candidates, relations)
    rows = checked.join(passages.select("passage_id", "text"), "passage_id", "left")
    exact, loose = F.expr("instr(text, quote)"), F.contains(folded(F.col("text")), folded(F.col("quote")))
    found = (F.length("quote") >= shortest_quote) & ((exact > 0) | loose)
    denied = F.when(F.col("polarity") == "positive", F.col("quote").rlike(MODAL_DENIAL)).when(F.col("polarity") == "negative", ~F.col("quote").rlike(ANY_DENIAL)).otherwise(F.lit(False))
    word = F.try_element_at(F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.coalesce(F.col("tail").try_cast("int"), F.lit(99)))
    said = F.contains(folded(F.col("quote")), folded(F.col("tail"))) | F.coalesce(F.contains(folded(F.col("quote")), word), F.lit(False))
    criterion = (
        F.when(F.col("problem").isNotNull(), "schema")
        .when((F.trim("head") == "") | (F.trim("tail") == ""), "empty")
        .when(F.col("text").isNull(), "citation")
        .when(~found, "quote")
        .when(denied, "polarity")
        .when((F.col("literal_type") == "str") & ~said, "value")
    )
    return rows.withColumns({"criterion": criterion, "start": F.when(exact > 0, exact - 1)})


def surfaces(mentions: DataFrame) -> DataFrame:
    """``entity_type, canonical, surfaces, contested``: sorted surfaces of each entity. ``mentions``: ``entity_type, canonical, surface``."""
    kinds = mentions.groupBy("canonical").agg(F.count_distinct("entity_type").alias("kinds"))
    out = mentions.groupBy("entity_type", "canonical").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
    return out.join(kinds, "canonical").select("entity_type", "canonical", "surfaces", (F.col("kinds") > 1).alias("contested"))
