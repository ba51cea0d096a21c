"""Picking a candidate per case, and comparing the pick with references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

CASE = ("entity", "context", "budget")
#: buckets whose counts lead to a page
PAGE_BUCKETS = 256


def ranked(candidates: DataFrame, case: Sequence[str] = CASE, candidate: str = "candidate",
           score: str = "score", quality: str = "quality") -> DataFrame:
    """Predicted rank and true rank inside each case.

    A case holds each candidate once, so the windows are as small as the
    registry.  Equal scores go to the lower candidate id; equal qualities go to
    the candidate the score prefers, which favours the model.
    """
    w = Window.partitionBy(*case)
    return (
        candidates
        .withColumn("predicted_rank", F.row_number().over(w.orderBy(F.desc(score), candidate)).cast("bigint"))
        .withColumn("oracle_rank", F.row_number().over(
            w.orderBy(F.desc(quality), F.desc(score), candidate)).cast("bigint"))
    )


def score_cases(candidates: DataFrame, fixed: DataFrame | None = None, case: Sequence[str] = CASE,
                fixed_key: Sequence[str] = ("budget", "context"), candidate: str = "candidate",
                score: str = "score", quality: str = "quality", cost: str = "shots") -> DataFrame:
    """Selected, oracle, random-expectation and fixed reference of every case.

    One shuffle on the case serves the two rankings and the summary; budgets
    are rows, not loops.
    """
    rows = candidates if fixed is None else candidates.join(
        fixed.select(*fixed_key, "fixed_candidate"), list(fixed_key), "left")
    first, best = F.col("predicted_rank") == 1, F.col("oracle_rank") == 1
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    aggs = [
        pick(first, candidate).alias("selected_candidate"),
        pick(first, cost).alias("selected_cost"),
        pick(first, quality).alias("selected_quality"),
        pick(first, score).alias("predicted_quality"),
        pick(best, candidate).alias("oracle_candidate"),
        pick(best, quality).alias("oracle_quality"),
        pick(best, "predicted_rank").alias("oracle_predicted_rank"),
        F.avg(quality).alias("random_expected_quality"),
    ]
    if fixed is not None:
        aggs += [F.max("fixed_candidate").alias("fixed_candidate"),
                 pick(F.col(candidate) == F.col("fixed_candidate"), quality).alias("fixed_quality")]
    cases = ranked(rows, case, candidate, score, quality).groupBy(*case).agg(*aggs)
    out = (
        cases.withColumn("regret", regret("oracle_quality", "selected_quality"))
        .withColumn("selected_is_oracle", F.col("selected_candidate") == F.col("oracle_candidate"))
        .withColumn("oracle_in_top3", F.col("oracle_predicted_rank") <= 3)
    )
    if fixed is not None:
        out = out.withColumn("selected_minus_fixed", F.col("selected_quality") - F.col("fixed_quality"))
    return out


def regret(oracle: str, selected: str) -> Column:
    gap = F.col(oracle) - F.col(selected)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def best_row(df: DataFrame, group: Sequence[str], by: str, candidate: str, carry: Sequence[str] = ()) -> DataFrame:
    """Row with the largest value, the lower candidate id on ties.

    An aggregate on a struct: it combines on the map side, so a hot group never
    reaches one task whole, unlike a ranked window.
    """
    key = F.struct((-F.col(by)).alias("_neg"), F.col(candidate), F.col(by), *[F.col(c) for c in carry])
    top = df.where(F.col(by).isNotNull()).groupBy(*group).agg(F.min(key).alias("_top"))
    return top.select(*group, f"_top.{candidate}", f"_top.{by}", *[f"_top.{c}" for c in carry])


def fixed_by_case(train: DataFrame, key: Sequence[str] = ("budget", "context"), candidate: str = "candidate",
                  quality: str = "quality", digits: int = 9) -> DataFrame:
    """Per (budget, context): the candidate with the best training mean."""
    means = train.groupBy(*key, candidate).agg(F.round(F.avg(quality), digits).alias("train_mean_quality"))
    return best_row(means, key, "train_mean_quality", candidate).withColumnRenamed(candidate, "fixed_candidate")


def fixed_global(train: DataFrame, candidate: str = "candidate", quality: str = "quality",
                 digits: int = 9) -> DataFrame:
    """The one candidate with the best training mean."""
    means = train.groupBy(candidate).agg(F.round(F.avg(quality), digits).alias("train_mean_quality"))
    return means.orderBy(F.desc("train_mean_quality"), candidate).limit(1)


def utility(quality: str, cost: str, alpha: Column | float, normalizer: float) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    spent = F.col(cost) / F.lit(float(normalizer))
    return a * F.col(quality) - (F.lit(1.0) - a) * F.when(spent.isNotNull(), F.least(spent, F.lit(1.0)))


def utility_choice(candidates: DataFrame, case: Sequence[str] = CASE, alpha: Column | float = 0.8,
                   normalizer: float = 102400.0, band: float = 0.005, digits: int = 9,
                   tie_order: Sequence[str] = ("cost", "depth", "shots", "candidate")) -> DataFrame:
    """Best utility per case; inside the near-tie band the cheapest candidate wins."""
    scored = candidates.withColumn("utility", F.round(utility("quality", "cost", alpha, normalizer), digits))
    top = F.max("utility").over(Window.partitionBy(*case))
    near = scored.withColumn("_top", top).where(F.col("utility") >= F.col("_top") - F.lit(band))
    won = F.min(F.struct(*tie_order, "utility", "quality")).alias("_won")
    return near.groupBy(*case).agg(won).select(
        *case, F.col("_won.candidate").alias("oracle_candidate"), F.col("_won.utility").alias("oracle_utility"),
        F.col("_won.quality").alias("oracle_quality"), F.col("_won.cost").alias("oracle_cost"))


def with_alphas(candidates: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """One copy per weight; the weight joins the case key."""
    return candidates.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))


def random_choice(candidates: DataFrame, case: Sequence[str], seed, candidate: str = "candidate") -> DataFrame:
    """One seeded candidate per case, drawn once and reusable in every scope."""
    from selectra.functions.hashing import row_hash

    drawn = candidates.withColumn("_h", row_hash(seed, *case, candidate))
    rest = [c for c in candidates.columns if c not in case]
    return drawn.groupBy(*case).agg(F.min(F.struct("_h", *rest)).alias("_pick")).select(
        *case, *[F.col(f"_pick.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last appended row of each key."""
    return _keep(df, key, sequence, F.max)


def keep_first(df: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    return _keep(df, key, sequence, F.min)


def _keep(df, key, sequence, extreme):
    rest = [c for c in df.columns if c not in key and c not in sequence]
    row = F.struct(*sequence, *rest)
    return df.groupBy(*key).agg(extreme(row).alias("_row")).select(
        *key, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in key])


def inconsistent_keys(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose attribute columns are not constant."""
    spread = [F.min(F.struct(*columns)).alias("_a"), F.max(F.struct(*columns)).alias("_b")]
    return df.groupBy(*key).agg(*spread).where("_a <> _b").select(*key)


def select_by_ids(df: DataFrame, key: str, ids: DataFrame, position: str = "position") -> DataFrame:
    """Rows of the requested ids in request order."""
    return df.join(ids, key).orderBy(position)


def unknown_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return ids.join(df.select(key), key, "left_anti")


def page(df: DataFrame, order: Sequence[str], batch: int, size: int) -> DataFrame:
    """The batch-th page (from 1) of the table in the given total order (nulls first).

    Rows are counted by ordered buckets of the first column; only the buckets that the page touches are sorted, however
    deep it lies. A column that is no number, and one whose values are all equal, are sorted whole.
    """
    if batch < 1 or size < 1:
        raise ValueError("batch and size start at 1")
    first, skip = order[0], (batch - 1) * size
    if not isinstance(df.schema[first].dataType, NumericType):
        return df.orderBy(*order).offset(skip).limit(size)
    cuts = sorted(set(df.approxQuantile(first, [i / PAGE_BUCKETS for i in range(1, PAGE_BUCKETS)], 0.25 / PAGE_BUCKETS)))
    # how many cuts lie below the value; nulls come before all
    bucket = F.when(F.col(first).isNull(), -1).otherwise(F.size(F.filter(F.lit(cuts), lambda c: c < F.col(first)))) if cuts else F.lit(0)
    counts, before, touched = dict(df.groupBy(bucket.alias("b")).count().collect()), 0, []
    start = 0
    for b in sorted(counts):
        if before + counts[b] > skip and before < skip + size:
            start = before if not touched else start
            touched.append(b)
        before += counts[b]
    return df.where(bucket.isin(touched or [-2])).orderBy(*order).offset(max(0, skip - start)).limit(size)


def filter_cases(df: DataFrame, **wanted: str) -> DataFrame:
    """Conjunction of optional filters; 'ALL' lets everything through."""
    for column, value in wanted.items():
        if value != "ALL":
            df = df.where(F.col(column) == F.lit(value))
    return df
