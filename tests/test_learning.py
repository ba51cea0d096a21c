"""The model path from comparison to the final job: returned scores are checked, and every metric is worked out again."""

import numpy as np
import pandas as pd
import pytest

from selectra.operators import learning
from selectra.plans import queries_learning as plans

MOST = {"B256": 256, "B512": 512}


@pytest.fixture(scope="module")
def chosen(tables):
    return plans.chosen(tables)


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()])


def cases_by_hand(scored):
    out = []
    for budget, most in MOST.items():
        for (entity, context), part in scored[scored.shots <= most].groupby(["entity", "context"]):
            pick = part.sort_values(["score", "candidate"], ascending=[False, True]).iloc[0]
            best = part.sort_values(["quality", "score", "candidate"], ascending=[False, False, True]).iloc[0]
            out.append((budget, entity, context, pick.candidate, pick.shots, max(0.0, best.quality - pick.quality),
                        pick.candidate == best.candidate))
    return pd.DataFrame(out, columns=["budget", "entity", "context", "candidate", "shots", "regret", "hit"])


def test_all_models_are_compared_on_their_scores(tables, chosen):
    validation = plans.model_rows(tables, "validation")
    wanted = frame(validation)
    results = {r["model"]: r for r in chosen.results.collect()}
    assert set(results) == set(learning.MODELS) == {"ridge", "random_forest", "extra_trees", "boosted_trees"}
    for name, score in chosen.fitted.items():
        scored = frame(score(validation))
        key = ["entity", "context", "candidate"]
        assert not scored.duplicated(key).any() and len(scored) == len(wanted)  # every candidate scored once
        assert set(map(tuple, scored[key].values)) == set(map(tuple, wanted[key].values))
        error = scored.score - scored.quality
        assert results[name]["rmse"] == pytest.approx(np.sqrt((error ** 2).mean()))
        assert results[name]["mae"] == pytest.approx(error.abs().mean())
        cases = cases_by_hand(scored)
        assert all(c.shots <= MOST[c.budget] for c in cases.itertuples())  # picks are affordable
        assert results[name]["mean_regret"] == pytest.approx(cases.regret.mean())
        assert results[name]["oracle_accuracy"] == pytest.approx(cases.hit.mean())
        assert results[name]["cases"] == len(cases)


def test_the_winner_is_the_first_by_regret(chosen):
    rows = sorted(chosen.results.collect(), key=lambda r: (r["mean_regret"], -r["oracle_accuracy"], r["rmse"], r["model"]))
    assert chosen.name == rows[0]["model"]
    assert [r["model"] for r in learning.by_error(chosen.results).collect()] == [
        r["model"] for r in sorted(rows, key=lambda r: (r["rmse"], r["model"]))]


def test_published_sizes(chosen):
    for name, count in (("random_forest", 500), ("extra_trees", 500), ("boosted_trees", 300)):
        nodes = chosen.fitted[name].nodes
        assert nodes.select("tree").distinct().count() == count
    leaves = chosen.fitted["boosted_trees"].nodes.where("feature < 0").groupBy("tree").count()
    assert leaves.agg({"count": "max"}).first()[0] <= 15


def test_structure_reaches_the_models(tables):
    rows = plans.model_rows(tables, "train")
    assert set(plans.STRUCTURE) <= set(rows.columns) and len(plans.STRUCTURE) == 20
    assert rows.select("entity", *plans.STRUCTURE).distinct().count() == rows.select("entity").distinct().count()
    width = learning.encode_features(rows, rows, plans.FULL).first()["features"].size
    assert width >= 22 + 2 + 7 + 1 + 3


def test_final_job(tables, chosen):
    rows = plans.model_rows(tables, "train", "validation", "test")
    job = learning.finalise(rows, plans.FULL, plans.ABLATIONS[:2], plans.MODEL_GROUPS[-3:], chosen, repetitions=3, resamples=200)
    assert set(job.tables) == {"model_comparison", "feature_ablation", "permutation_importance", "fixed_choices",
                               "test_scores", "test_cases", "test_summary", "test_statistics", "manifest"}
    scored = frame(job.tables["test_scores"])
    assert set(scored.split) == {"test"} and not scored.duplicated(["entity", "context", "candidate"]).any()
    cases = cases_by_hand(scored)
    summary = frame(job.tables["test_summary"]).set_index("scope")
    assert len(summary) == 12
    assert summary.loc["ALL"].mean_regret == pytest.approx(cases.regret.mean())
    assert summary.loc["ALL"].oracle_accuracy == pytest.approx(cases.hit.mean())
    for budget, part in cases.groupby("budget"):
        assert summary.loc[budget].mean_regret == pytest.approx(part.regret.mean())
    manifest = job.tables["manifest"].first()
    assert manifest["selected_model"] == chosen.name and manifest["test"] == scored.entity.nunique()
    assert manifest["rmse"] == pytest.approx(np.sqrt(((scored.score - scored.quality) ** 2).mean()))
    assert len(frame(job.tables["feature_ablation"])) == 2 and len(frame(job.tables["permutation_importance"])) == 3
