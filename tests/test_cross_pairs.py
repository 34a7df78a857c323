import random

from goldweave.operators import cells, evaluation

LINKS = "entity_id long, ref string"


def links(rng, n):
    return [(rng.choice([None, *range(6)]) if rng.random() < 0.9 else 100 + i, f"table{rng.randint(1, 2)}:{rng.randint(1, 25)}") for i in range(n)]


def pairs(rows):
    of = lambda t: {(e, r[7:]) for e, r in rows if e is not None and r.startswith(t)}
    return {(x, y) for e, x in of("table1:") for f, y in of("table2:") if e == f}


def test_pairs_and_counts_of_references_in_several_entities(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_PAIRS", 9)
    rng = random.Random(4)
    for n in (0, 12, 70):
        p, t = links(rng, n), links(rng, n)
        frames = [spark.createDataFrame(x, LINKS) for x in (p, t)]
        found = [tuple(r) for r in evaluation.cross_pairs(frames[0]).collect()]
        assert len(found) == len(set(found)) and set(found) == pairs(p)
        a, b = pairs(p), pairs(t)
        assert tuple(evaluation.cross_counts(*frames).first()) == (len(a & b), len(a - b), len(b - a))


def test_counts_do_not_make_the_pairs(spark):
    """Four hundred million pairs of one entity, from forty thousand references."""
    p = spark.range(40_000).selectExpr("0L as entity_id", "concat('table', 1 + id % 2, ':', id) as ref")
    t = p.where("not endswith(ref, '7')").selectExpr("entity_id", "ref", "'x' as title")
    row = evaluation.eval_report(p, t, p.selectExpr("entity_id", "'X' as canonical_title").distinct()).first()
    assert (row.tp, row.fp, row.fn) == (20_000 * 16_000, 20_000 * 4_000, 0)


def test_vectors_look_up_each_term_once(spark):
    """The weights of a record come with its length, not from a second pass over all terms."""
    from goldweave.operators import features

    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"])], "id long, words array<string>")
    counts = features.term_counts(rows, rows.words)
    vectors = features.tfidf_vectors(counts, features.tfidf_idf(counts, 2))
    length = {r.id: r.n for r in vectors.groupBy("id").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    assert set(length) == {1, 2}
    for i in (1, 2):
        assert abs(sum(r.w**2 for r in vectors.where(f"id = {i}").collect()) - 1) < 1e-12
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
