"""Models that score candidates, their selection by regret, and what they rely on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from selectra.operators import trees
from selectra.operators.aggregates import cube_summary, regression_metrics, selection_metrics, share
from selectra.operators.selection import fixed_by_case, score_cases
from selectra.operators.splits import permute_units
from selectra.operators.statistics import clustered_stats
from selectra.session import materialise, spread
from selectra.sources.registries import BUDGETS, expand_budgets

ScoreFn = Callable[[DataFrame], DataFrame]
"""Adds a ``score`` column: a fitted model, an SQL expression or a pandas UDF."""


@dataclass(frozen=True)
class FeatureSet:
    name: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    def without(self, name: str, columns: Sequence[str]) -> "FeatureSet":
        return FeatureSet(name, tuple(c for c in self.numeric if c not in columns),
                          tuple(c for c in self.categorical if c not in columns))


def encode_stages(features: FeatureSet, out: str = "features") -> list:
    """One-hot categories (the slot for unseen values is constant 0 in training) and numbers."""
    stages, inputs = [], list(features.numeric)
    if features.categorical:
        index = [f"_i_{c}" for c in features.categorical]
        hot = [f"_h_{c}" for c in features.categorical]
        stages = [StringIndexer(inputCols=list(features.categorical), outputCols=index, handleInvalid="keep",
                                stringOrderType="alphabetAsc"),
                  OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False, handleInvalid="keep")]
        inputs = hot + inputs
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out)]


def encode_features(train: DataFrame, df: DataFrame, features: FeatureSet) -> DataFrame:
    return Pipeline(stages=encode_stages(features)).fit(train).transform(df)


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline as a scoring function."""

    model: PipelineModel

    def __call__(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns]
        return self.model.transform(df).select(*keep, F.col("prediction").alias("score"))


@dataclass(frozen=True)
class GrownTrees:
    """A node table as a scoring function: a start and the sum of the trees' values, or their mean."""

    encoder: PipelineModel
    nodes: DataFrame
    start: float = 0.0
    mean_of: int = 1

    @cached_property
    def packed(self) -> DataFrame:
        return trees.packed(self.nodes)

    def __call__(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        rows = materialise(self.encoder.transform(df).select(
            *df.columns, x.alias("x"), F.monotonically_increasing_id().alias("_row")))
        sums = trees.tree_sums(rows, self.nodes, self.packed)
        score = F.lit(self.start) + F.col("_sum") / F.lit(float(self.mean_of))
        return rows.join(sums, "_row").select(*df.columns, score.alias("score"))


def tree_rows(encoder: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    return encoder.transform(df).select(vector_to_array("features").alias("x"), F.col(target).cast("double").alias("y"))


def fit_ridge(train: DataFrame, features: FeatureSet, target: str, alpha: float = 1.0) -> Fitted:
    """Scaled, uncentred inputs and an L2 penalty of alpha on the sum of squares.

    The scaler divides by the sample deviation, the solver averages the loss over
    n rows and penalises in units of the target deviation; the factor on alpha
    undoes all three.
    """
    size = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    penalty = alpha * (size["n"] - 1) / size["n"] ** 2 * size["s"]
    stages = [*encode_stages(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=False),
              LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=0.0,
                               standardization=False, solver="normal")]
    return Fitted(Pipeline(stages=stages).fit(train))


def fit_forest(train: DataFrame, features: FeatureSet, target: str, count: int = 500, leaf: int = 2,
               seed: int = 2027) -> GrownTrees:
    """Random forest: drawn rows, the best of all cuts, no depth limit."""
    encoder = Pipeline(stages=encode_stages(features)).fit(train)
    return GrownTrees(encoder, trees.grow_forest(tree_rows(encoder, train, target), count, leaf, seed), 0.0, count)


def fit_boosted(train: DataFrame, features: FeatureSet, target: str, rounds: int = 300, rate: float = 0.05,
                leaves: int = 15, l2: float = 1.0, leaf: int = 20) -> GrownTrees:
    """Gradient boosting with a leaf limit and an L2 term on the leaf values."""
    encoder = Pipeline(stages=encode_stages(features)).fit(train)
    nodes, start = trees.grow_boosted(tree_rows(encoder, train, target),
                                      trees.Boosting(rounds, rate, leaves, l2, leaf))
    return GrownTrees(encoder, nodes, start)


def fit_extra_trees(train: DataFrame, features: FeatureSet, target: str, count: int = 500, leaf: int = 2,
                    seed: int = 2027) -> GrownTrees:
    """Extremely randomised trees on all rows, without a depth limit."""
    encoder = Pipeline(stages=encode_stages(features)).fit(train)
    return GrownTrees(encoder, trees.grow_extra_trees(tree_rows(encoder, train, target), count, leaf, seed), 0.0, count)


def fit_line(train: DataFrame, x: str, target: str) -> DataFrame:
    """One-feature least squares as a one-row frame (slope, intercept)."""
    return train.agg(F.regr_slope(F.col(target), F.col(x)).alias("slope"),
                     F.regr_intercept(F.col(target), F.col(x)).alias("intercept"))


def line_scorer(train: DataFrame, x: str, target: str, digits: int = 12) -> ScoreFn:
    """The fitted line as a scoring function; two numbers leave the training rows."""
    row = fit_line(train, x, target).first()
    return lambda df: df.withColumn(
        "score", F.round(F.lit(row["intercept"]) + F.lit(row["slope"]) * F.col(x), digits))


MODELS: Mapping[str, Callable[..., ScoreFn]] = {
    "ridge": fit_ridge,
    "random_forest": fit_forest,
    "extra_trees": fit_extra_trees,
    "boosted_trees": fit_boosted,
}


def evaluate(score: ScoreFn, df: DataFrame, target: str = "quality", budgets=BUDGETS) -> DataFrame:
    """One row: prediction errors over the rows, decision quality over the cases."""
    scored = materialise(score(df))  # two aggregates read it
    errors = scored.agg(*[c.alias(n) for n, c in regression_metrics(target, "score").items()]).first()
    cases = score_cases(expand_budgets(scored, budgets), quality=target)
    decisions = cases.agg(
        F.avg("selected_quality").alias("selected_mean"), F.avg("oracle_quality").alias("oracle_mean"),
        F.avg("regret").alias("mean_regret"), share(F.col("selected_is_oracle")).alias("oracle_accuracy"),
        share(F.col("oracle_in_top3")).alias("oracle_top3_accuracy"), F.count(F.lit(1)).alias("cases"))
    return decisions.select("*", *[F.lit(v).alias(n) for n, v in errors.asDict().items()])


RANKING = ("mean_regret asc", "oracle_accuracy desc", "rmse asc", "model asc")


def rank_models(results: DataFrame) -> DataFrame:
    """Best first: low regret, then high accuracy, low error, name."""
    return results.orderBy(*[F.expr(r.split()[0]).desc() if r.endswith("desc") else F.expr(r.split()[0])
                             for r in RANKING])


def compare_models(train: DataFrame, validation: DataFrame, features: FeatureSet,
                   models: Mapping[str, Callable[..., ScoreFn]] = MODELS, target: str = "quality",
                   options: Mapping[str, Mapping] | None = None) -> tuple[DataFrame, dict[str, ScoreFn]]:
    """Fit every model on train and rank them by validation regret."""
    train, validation = materialise(train), materialise(validation)
    fitted = {n: fit(train, features, target, **(options or {}).get(n, {})) for n, fit in models.items()}
    rows = [evaluate(s, validation, target).withColumn("model", F.lit(n)) for n, s in fitted.items()]
    return rank_models(reduce(DataFrame.unionByName, rows)), fitted


def by_error(results: DataFrame) -> DataFrame:
    """Best first by prediction error alone."""
    return results.orderBy("rmse", "model")


@dataclass(frozen=True)
class Chosen:
    """The outcome of a comparison: all results, the name of the best model, and the fitted models."""

    results: DataFrame
    name: str
    fitted: Mapping[str, ScoreFn]


def choose(train: DataFrame, validation: DataFrame, features: FeatureSet,
           models: Mapping[str, Callable[..., ScoreFn]] = MODELS, target: str = "quality",
           order: Callable[[DataFrame], DataFrame] = rank_models) -> Chosen:
    """Compare all models on the validation entities; one row names the winner."""
    results, fitted = compare_models(train, validation, features, models, target)
    results = materialise(order(results))
    return Chosen(results, order(results).first()["model"], fitted)


@dataclass(frozen=True)
class FinalJob:
    """Everything a final selection job hands on, as frames by name, and the frozen model behind them."""

    model: ScoreFn
    tables: Mapping[str, DataFrame]


def finalise(rows: DataFrame, features: FeatureSet, ablations: Sequence[FeatureSet], groups: Sequence["FeatureGroup"],
             chosen: Chosen | None = None, models: Mapping[str, Callable[..., ScoreFn]] = MODELS,
             repetitions: int = 30, resamples: int = 10_000, seed: int = 2027, target: str = "quality") -> FinalJob:
    """The whole job on candidate rows with a split: compare on validation, choose, ablate and permute the winner, refit
    it on train and validation, and only then score the test entities once, against fixed, random and oracle choices."""
    part = lambda *names: rows.where(F.col("split").isin(*names))
    train, validation, test = part("train"), part("validation"), part("test")
    chosen = chosen or choose(train, validation, features, models, target)
    fit = models[chosen.name]
    ablation = ablate(fit, train, validation, ablations, target, {features: chosen.fitted[chosen.name]})
    importance = permutation_importance(validation, chosen.fitted[chosen.name], groups, repetitions, seed, quality=target)
    model = fit(part("train", "validation"), features, target)
    scored = materialise(model(test))
    fixed = fixed_by_case(expand_budgets(train), quality=target)
    cases = materialise(score_cases(expand_budgets(scored), fixed, quality=target))
    summary = cube_summary(cases, ["budget", "context"], selection_metrics())
    errors = scored.agg(*[c.alias(n) for n, c in regression_metrics(target, "score").items()]).first().asDict()
    counts = rows.groupBy("split").agg(F.countDistinct("entity").alias("entities"))
    facts = [F.lit(chosen.name).alias("selected_model"), F.lit(len(features.numeric) + len(features.categorical)).alias("features"),
             F.lit("train+validation").alias("fitted_on"), F.lit(repetitions).alias("permutation_repetitions"),
             F.lit(resamples).alias("bootstrap_repetitions"), F.lit(seed).alias("seed")]
    sizes = counts.groupBy().pivot("split", ["train", "validation", "test"]).agg(F.first("entities"))
    return FinalJob(model, {
        "model_comparison": chosen.results, "feature_ablation": ablation, "permutation_importance": importance,
        "fixed_choices": fixed, "test_scores": scored, "test_cases": cases, "test_summary": summary,
        "test_statistics": clustered_stats(cases, repetitions=resamples, sampled=resamples, seed=seed),
        "manifest": sizes.select("*", *[F.lit(v).alias(n) for n, v in errors.items()], *facts)})


def ablate(fit: Callable[..., ScoreFn], train: DataFrame, validation: DataFrame,
           feature_sets: Sequence[FeatureSet], target: str = "quality",
           known: Mapping[FeatureSet, ScoreFn] | None = None, **options) -> DataFrame:
    """The same model on several feature sets, least regret first; ``known`` holds those that were fitted before."""
    train, validation = materialise(train), materialise(validation)
    rows = [evaluate((known or {}).get(fs) or fit(train, fs, target, **options), validation, target).withColumn(
        "ablation", F.lit(fs.name)) for fs in feature_sets]
    return reduce(DataFrame.unionByName, rows).orderBy("mean_regret", "ablation")


# Permutation importance ---------------------------------------------------------------

@dataclass(frozen=True)
class FeatureGroup:
    name: str
    columns: tuple[str, ...]
    unit: str  # "entity", "context" or "candidate"


#: groups over which the rows of a context or candidate are dealt
SALTS = 64


def permuted_variants(df: DataFrame, groups: Sequence[FeatureGroup], repetitions: int, seed) -> DataFrame:
    """Every (group, repetition) copy of the rows in one frame.

    Features move coherently at their natural unit: for each variant one
    bijection of the units names a donor, and the columns of the group are read
    from the donor.  ``candidate_id`` and ``feasibility_cost`` stay as they are,
    so a permuted descriptor never changes what is affordable.
    """
    base = materialise(df.withColumn("candidate_id", F.col("candidate")).withColumn("feasibility_cost", F.col("shots")))
    frames = []
    for unit in ("entity", "context", "candidate"):
        mine = [g for g in groups if g.unit == unit]
        if mine:
            frames.append(_unit_variants(base, mine, unit, repetitions, seed))
    return reduce(DataFrame.unionByName, frames)


def _unit_variants(base: DataFrame, groups, unit: str, repetitions: int, seed) -> DataFrame:
    columns = sorted({c for g in groups for c in g.columns})
    names = F.array(*[F.lit(g.name) for g in groups])
    own = base.groupBy(F.col(unit).alias("_unit")).agg(*[F.min(c).alias(f"_d_{c}") for c in columns])
    variants = own.withColumn("feature_group", F.explode(names)).withColumn(
        "repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    per_variant = F.concat_ws("|", F.lit(str(seed)), F.col("feature_group"), F.col("repetition").cast("string"))
    donors = permute_units(variants, "_unit", [f"_d_{c}" for c in columns], per_variant, ["feature_group", "repetition"])
    rows, on = base.withColumn("_unit", F.col(unit)), ["_unit"]
    if unit != "entity":  # few units with very many rows each
        rows, on = rows.withColumn("_salt", F.pmod(F.xxhash64("entity"), F.lit(SALTS)).cast("int")), ["_unit", "_salt"]
        donors = donors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    moved = spread(rows, *on).join(spread(donors, *on), on)  # small rows, but each becomes one per variant
    swap = lambda c: F.when(
        F.col("feature_group").isin(*[g.name for g in groups if c in g.columns]), F.col(f"_d_{c}")).otherwise(F.col(c))
    kept = [F.col(c) if c not in columns else swap(c).alias(c) for c in base.columns]
    # the identity of a case must not move with its features
    identity = [F.col(c).alias(f"case_{c}") for c in ("entity", "context")]
    return moved.select("feature_group", "repetition", *identity, *kept)


def permutation_importance(df: DataFrame, score: ScoreFn, groups: Sequence[FeatureGroup], repetitions: int = 30,
                           seed=2027, budgets=BUDGETS, quality: str = "quality") -> DataFrame:
    """Mean and deviation of the regret increase per feature group.

    All variants are scored by one call and reduced by one aggregation.
    """
    base = df.select("*", F.lit("").alias("feature_group"), F.lit(0).alias("repetition"),
                     F.col("entity").alias("case_entity"), F.col("context").alias("case_context"),
                     F.col("candidate").alias("candidate_id"), F.col("shots").alias("feasibility_cost"))
    variants = permuted_variants(df, groups, repetitions, seed).unionByName(base)
    # a row is compared once for each budget it fits in, without a copy per budget
    case = ["feature_group", "repetition", "case_entity", "case_context"]
    row, fits = F.struct((-F.col("score")).alias("_s"), "candidate_id", F.col(quality).alias("_q")), F.col("feasibility_cost")
    best = [[F.min(F.when(fits <= most, row)).alias(f"_pick{i}"), F.max(F.when(fits <= most, F.col(quality))).alias(f"_top{i}")]
            for i, (_, most) in enumerate(budgets)]
    picks = F.array(*[F.when(F.col(f"_pick{i}").isNotNull(), F.greatest(F.lit(0.0), F.col(f"_top{i}") - F.col(f"_pick{i}._q")))
                      for i in range(len(budgets))])
    cases = score(variants).groupBy(*case).agg(*[c for pair in best for c in pair]).select(
        *case, F.explode(picks).alias("regret")).where("regret IS NOT NULL")
    runs = cases.groupBy("feature_group", "repetition").agg(F.avg("regret").alias("regret"))
    names = F.array(*[F.lit(g.name) for g in groups])
    baseline = runs.where(F.col("repetition") == 0).select(
        F.explode(names).alias("feature_group"), F.col("regret").alias("baseline_regret"))
    gains = runs.where(F.col("repetition") > 0).join(baseline, "feature_group")
    gain = F.col("regret") - F.col("baseline_regret")
    return gains.groupBy("feature_group").agg(
        F.first("baseline_regret").alias("baseline_regret"), F.avg(gain).alias("mean_increase"),
        F.stddev_samp(gain).alias("std_increase"), F.count(F.lit(1)).alias("repetitions"))


def top_importance(importance: DataFrame, n: int = 12) -> DataFrame:
    return importance.orderBy(F.desc("mean_increase"), "feature_group").limit(n)


def weighted_score(expression: Column) -> ScoreFn:
    """A scoring function from a column expression."""
    return lambda df: df.withColumn("score", expression)
