"""The learning dataset out of raw runs, as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from selectra.operators.aggregates import admit_complete, replicate_spread
from selectra.operators.splits import entity_split
from selectra.session import materialise


@dataclass(frozen=True)
class DatasetSpec:
    """Names of the columns, the candidates that each required context must have, and the codes of categories."""

    entity: str
    context: str
    candidate: str
    settings: Sequence[str]
    target: str
    contexts: Sequence[str]
    candidates: int
    codes: Mapping[str, Mapping[str, int]]


def build_dataset(runs: DataFrame, features: DataFrame, spec: DatasetSpec, seed, success: Column | None = None) -> DataFrame:
    """One row per entity, context and candidate of the common population: mean, deviation and number of its replicates,
    the features of the entity, category codes and the split.

    The population is every entity that has all required contexts with all candidates; it alone is split, so the shares
    hold for what is learned from. An entity without features keeps its rows with nulls; a category without a code gives
    null. The aggregated table is kept once: runs are scanned once.
    """
    done = runs if success is None else runs.where(success)
    cells = materialise(replicate_spread(done, [spec.entity, spec.context, spec.candidate, *spec.settings], spec.target))
    admitted = admit_complete(cells, spec.entity, spec.context, spec.candidate, spec.contexts, spec.candidates).where(
        "admitted").select(spec.entity)
    splits = entity_split(admitted, spec.entity, seed)
    rows = cells.where(F.col(spec.context).isin(*spec.contexts)).join(splits, spec.entity).join(features, spec.entity, "left")
    coded = [F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col(c)].cast("bigint").alias(f"{c}_code")
             for c, codes in spec.codes.items()]
    return rows.select("*", *coded)


def population_report(dataset: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Per split: entities, rows, and rows of each context."""
    return dataset.groupBy("split").agg(
        F.count_distinct(spec.entity).alias("entities"), F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(spec.context) == c).alias(f"rows_{c}") for c in spec.contexts])
