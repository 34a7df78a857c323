from goldweave.operators import blocking
from goldweave.plans import catalog, master_catalog


def test_candidates_are_made_once(spark, sf, monkeypatch):
    """The low pairs and the clusters that they are kept from come from one run of the candidate step."""
    made, block = [], blocking.block_schema
    monkeypatch.setattr(blocking, "block_schema", lambda *a, **b: made.append(1) or block(*a, **b))
    row = master_catalog.QUERIES["low_pairs"](spark, sf).first()
    assert len(made) == 1
    s = {(r.l_id, r.r_id): r for r in catalog.scored(spark, sf).collect()}
    kept = catalog.kept_pairs(spark, sf).select("l_id", "r_id").collect() + catalog.graph.mutual_best(catalog.scored(spark, sf)).select("l_id", "r_id").collect()
    ends = {r.l_id for r in kept}, {r.r_id for r in kept}
    low = [r.confidence for r in s.values() if r.confidence < 0.59 and r.l_id not in ends[0] and r.r_id not in ends[1]]
    assert row.n == len(low) and row.best == round(max(low), 6)
