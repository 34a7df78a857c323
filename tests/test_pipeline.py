import random

import pytest
from pyspark.sql import functions as F

from goldweave.operators import adjudicate, blocking, golden, graph, prepare, scoring
from goldweave.plans import profile
from goldweave.plans.engine import Engine, SchemaMismatch
from goldweave.streaming.incremental import resolve_stream

A = [("a1", "Microsoft Visio Standard 2007", "Microsoft", "129.95"), ("a2", "Adobe Photoshop Elements", "Adobe Systems", "89.99")]
B = [("b1", "microsoft visio standard 2007 version upgrade", "MS", "129.95"), ("b2", "QuickBooks 2007 Learning Guide", "Intuit", "38.99")]
COLS = "id string, title string, manufacturer string, price string"


def side(spark, rows):
    return prepare.with_tokens(prepare.preprocess(spark.createDataFrame(rows, COLS)))


def test_no_shared_token_gives_no_candidates(spark):
    left = side(spark, [(f"a{i}", f"alpha{i}", f"m{i}", "1") for i in range(10)])
    right = side(spark, [(f"b{i}", f"beta{i}", f"n{i}", "1") for i in range(10)])
    pairs = blocking.block_canonical(left, right)
    assert pairs.count() == 0
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_mutual_best(spark):
    rows = [("a1", "b1", 0.74, False), ("a1", "b2", 0.62, False)]
    got = graph.mutual_best(spark.createDataFrame(rows, "l_id string, r_id string, confidence double, conflict boolean")).collect()
    assert [(r.l_id, r.r_id) for r in got] == [("a1", "b1")]


def test_conflict_goes_to_a_cluster(spark):
    pair = spark.createDataFrame([("a1", "b1", 0.93, "m", "m", 100.0, 180.0)], "l_id string, r_id string, confidence double, l_maker string, r_maker string, l_price double, r_price double")
    pair = pair.withColumn("conflict", graph.field_conflict(F.col("l_maker"), F.col("r_maker"), F.col("l_price"), F.col("r_price")))
    assert graph.mutual_best(pair).count() == 0
    out = graph.routed(graph.clusters(pair, graph.components(pair))).first()
    assert out.routing_decision == "llm_cluster"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_sets(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(25)}
    groups = []
    for a, b in edges:
        own = {f"l:{a}", f"r:{b}"}
        near = [g for g in groups if g & own]
        groups = [g for g in groups if not g & own] + [own.union(*near)]
    got = graph.components(spark.createDataFrame(list(edges), "l_id int, r_id int")).collect()
    assert {(f"{r.side}:{r.id}", r.component) for r in got} == {(n, min(g)) for g in groups for n in g}


def test_rank_pct(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.5), (4, 0.9)], "id int, v double")
    assert {r.id: r.rank_pct for r in scoring.rank_pct(df, "v").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}
    assert scoring.rank_pct(df.where("id = 4"), "v").first().rank_pct == 0.9


def test_schema_profiles(spark):
    pub = spark.createDataFrame([("1", "Deep sets", "A. B", "VLDB", "2001")], "id string, title string, authors string, venue string, year string")
    prod = spark.createDataFrame([("1", "Deep sets", "Intuit", "3.5")], COLS)
    assert not profile.analyze(prod, pub).related
    found = profile.analyze(pub, pub)
    assert found.related and found.confidence == 0.98 and found.entity_type == "publication" and len(found.weights) == 4
    beer = spark.createDataFrame([("1", "Ale", "Brew Co", "IPA", "5 %")], "id string, Beer_Name string, Brew_Factory_Name string, Style string, ABV string")
    got = profile.analyze(beer, beer)
    assert got.entity_type == "beer" and got.master_columns == ["Beer_Name", "Brew_Factory_Name", "Style", "ABV"]
    generic = spark.createDataFrame([("1", "Song of songs", "X", "Y", "180")], "row_id string, Track string, Artist string, Album string, LengthSec string")
    got = profile.analyze(generic, generic)
    assert got.related and got.entity_type == "unknown" and got.column_roles["Track"] == "primary_name"


def test_tolerant_json():
    parse = adjudicate.loads_tolerant
    assert parse('<think>{x</think>\n```json\n{"clusters": []}\n```') == {"clusters": []}
    assert parse('"{\\"a\\": 1}"') == {"a": 1}
    assert parse("[1]") == {"items": [1]}
    assert parse('noise {"a": 2} more') == {"a": 2}
    assert parse('{"a": ') == {} and parse(None) == {}


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    run = engine.resolve(spark.createDataFrame(A, COLS), spark.createDataFrame(B, COLS))
    got = engine.finalize(run.run_id).first()
    assert got.valid and got.links_a == 2 and got.links_b == 2
    assert engine.search("visio").count() >= 1
    again = engine.repair(spark.createDataFrame(A, COLS), "table1")
    assert again == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("id,title,manufacturer,price\nc1,Adobe Photoshop Elements,Adobe,89.99\nc2,Norton Antivirus,Symantec,20\n")
    for _ in range(2):
        stream = spark.readStream.schema(COLS).option("header", True).csv(str(tmp_path / "in"))
        resolve_stream(stream, engine, str(tmp_path / "ck")).awaitTermination(120)
    links = engine.store.read("links")
    assert links.count() == 6 and links.where("source_table = 'incoming'").count() == 2
    assert engine.quality().first().valid
    with pytest.raises(SchemaMismatch):
        engine.resolve_incremental(spark.createDataFrame([("1",)], "x string"))


def test_decisions_need_every_member_once(spark):
    want = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "cluster_id string, member string")
    given = spark.createDataFrame([("c", "x"), ("c", "x"), ("d", "z"), ("e", "q")], "cluster_id string, member string")
    got = {r.cluster_id: r for r in adjudicate.validate_members(want, given).collect()}
    assert set(got) == {"c", "d"} and got["d"].valid and not got["c"].valid and got["c"].missing == 1 and got["c"].repeated == 1


def test_upsert_replaces(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert {tuple(r) for r in golden.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
