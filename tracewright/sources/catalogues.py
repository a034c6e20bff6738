"""Catalogues in YAML: relations of an ontology and its extensions, telemetry profiles, factors."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

RELATION = "name string, domain array<string>, range array<string>, literal_type string, enum array<string>, polarity string, cardinality string, materiality string, kind string, dimension string, scope string, grouping string"
#: Fixed values that a relation may have.
ALLOWED = {"polarity": ("positive", "negative", "neutral"), "cardinality": ("one", "many"), "materiality": ("high", "normal"), "literal_type": (None, "str", "bool", "int", "enum"), "grouping": (None, "per_triple", "per_head", "all")}


class BadCatalogue(ValueError):
    """A catalogue that contradicts itself or what it extends."""


def _relation(raw: dict[str, Any]) -> dict[str, Any]:
    checks = raw.get("checks") or {}
    if bool(checks) == bool(raw.get("not_checkable")):
        raise BadCatalogue(f"{raw.get('name')}: either checks or not_checkable")
    out = {k: raw.get(k) for k in ("name", "literal_type")} | {k: list(raw.get(k) or []) for k in ("domain", "range", "enum")}
    out |= {"polarity": raw.get("polarity", "neutral"), "cardinality": raw.get("cardinality", "many"), "materiality": raw.get("materiality", "normal")}
    out |= {k: checks.get(k) for k in ("kind", "dimension", "scope", "grouping")}
    for field, values in ALLOWED.items():
        if out[field] not in values:
            raise BadCatalogue(f"{out['name']}: {field} is {out[field]!r}")
    if (out["literal_type"] == "enum") != bool(out["enum"]):
        raise BadCatalogue(f"{out['name']}: an enum needs values, and only an enum has them")
    return out


def relations(text: str, extension: str | None = None) -> list[dict[str, Any]]:
    """Relations of an ontology. An extension may add relations and narrow domains and ranges, never widen them."""
    found = {r["name"]: _relation(r) for r in yaml.safe_load(text)["relations"]}
    for raw in (yaml.safe_load(extension) or {}).get("relations", []) if extension else []:
        old = found.get(raw["name"])
        if old is None:
            found[raw["name"]] = _relation(raw)
            continue
        for field in ("domain", "range"):
            if raw.get(field):
                if wider := sorted(set(raw[field]) - set(old[field])):
                    raise BadCatalogue(f"{raw['name']}: {field} would be widened by {wider}")
                old[field] = list(raw[field])
    return list(found.values())


def relation_frame(spark: SparkSession, found: list[dict[str, Any]]) -> DataFrame:
    names = [f.split(" ")[0] for f in RELATION.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], RELATION)


def profile_frame(spark: SparkSession, text: str) -> DataFrame:
    """``entity_type, wire, entity`` of a telemetry profile's names."""
    kinds = {"capabilities": "Capability", "tools": "Tool", "outcomes": "Outcome", "states": "State", "variables": "Variable"}
    raw = yaml.safe_load(text)
    rows = [(kind, str(wire), str(name)) for field, kind in kinds.items() for name, wire in (raw.get(field) or {}).items()]
    return spark.createDataFrame(rows, "entity_type string, wire string, entity string")


def factors(text: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Levels of the invariant factors, and their adverse levels; names are unique and levels at least two."""
    levels: dict[str, list[str]] = {}
    adverse: dict[str, str] = {}
    for raw in yaml.safe_load(text)["factors"]:
        name, values = raw["name"], [str(v) for v in raw["levels"]]
        if name in levels or len(set(values)) < 2 or len(set(values)) != len(values):
            raise BadCatalogue(f"{name}: names and levels must be distinct, and levels two at least")
        if raw.get("adverse") is not None and str(raw["adverse"]) not in values:
            raise BadCatalogue(f"{name}: the adverse level is none of its levels")
        if raw.get("invariant", True):
            levels[name] = values
            if raw.get("adverse") is not None:
                adverse[name] = str(raw["adverse"])
    return levels, adverse
