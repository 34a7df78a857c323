from goldweave.operators import features
from goldweave.plans.catalog import neighbours, records


def test_each_similarity_has_a_plan_of_its_own(spark, sf):
    """The terms are counted before the features are joined, so no plan of all of them fills the driver."""
    r = records(spark, sf)
    out = features.FeatureBuilder.fit(r).transform(neighbours(r))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 3
    assert out.count() == neighbours(r).count() and set(features.FEATURES) <= set(out.columns)
