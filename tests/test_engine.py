import json
import shutil

import pytest

from goldweave.operators import adjudicate, cards, commit, evaluation, feature_model, golden, scoring
from goldweave.plans import profile
from goldweave.plans.engine import Engine, SchemaMismatch
from goldweave.sources import tables

COLS = "id string, title string, manufacturer string, price string"
A = [("a1", "Norton Antivirus 2007 Pack", "Symantec", "20"), ("a2", "Norton Antivirus 2007 Pack Mac", "Symantec", "21"), ("a3", "Acme Photo Studio Suite", "Acme", "50"), ("a4", "Acme Photo Studio Suite Pro", "Acme", "51"), ("a5", "Quicken Home", "Intuit", "9")]
B = [("b1", "Norton Antivirus 2007 Pack Win", "Symantec", "20"), ("b2", "Norton Antivirus 2007 Pack PC", "Symantec", "20"), ("b3", "Acme Photo Studio Suite Mac", "Acme", "50"), ("b4", "Acme Photo Studio Suite Win", "Acme", "50"), ("b5", "Bonus Garden Tools", "Yard", "7")]


@pytest.fixture(scope="module")
def resolved(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("master")
    return root, Engine(spark, str(root)).resolve(spark.createDataFrame(A, COLS), spark.createDataFrame(B, COLS))


@pytest.fixture()
def run(spark, resolved, tmp_path):
    """An engine on a copy of the resolved master."""
    root, found = resolved
    shutil.copytree(root, tmp_path / "master")
    return Engine(spark, str(tmp_path / "master")), found


def answer(engine, run_id, offset=0, limit=50, drop=0, extra=False, title="Chosen title"):
    rows = engine.expected_members(run_id, offset, limit).collect()
    clusters = {}
    for r in rows:
        clusters.setdefault((r.cluster_seq, r.cluster_id), []).append(r.member)
    out = [{"cluster_id": c, "entities": [{"canonical_title": title, "members": sorted(m)[drop:], "confidence": 0.9, "decision": "same_entity"}]} for (_, c), m in sorted(clusters.items())]
    return {"clusters": out + ([{"cluster_id": "other", "entities": [{"canonical_title": "x", "members": ["table1:zz"]}]}] if extra else [])}


def test_batches_are_committed_once(run):
    engine, found = run
    assert found.status == "llm_required" and found.pending.count() == 2
    wrapped = "<think>hm</think>```json\n" + json.dumps(answer(engine, found.run_id, extra=True)) + "\n```"
    reply = engine.commit_batch(found.run_id, json.dumps({"text": wrapped}))
    assert reply["status"] == "committed" and reply["committed_count"] == 2 and not reply["has_more"]
    assert engine.commit_batch(found.run_id, "broken")["status"] == "already_committed"
    links = {(r.source_table, r.source_id): r.entity_id for r in engine.table("links").collect()}
    assert len(links) == 10 and links["table1", "a1"] == links["table2", "b2"] != links["table1", "a3"]
    quality = engine.finalize(found.run_id).first()
    assert quality.valid and quality.coverage_a and quality.coverage_b and (quality.links_a, quality.links_b) == (5, 5)
    assert engine.master().where("title = 'Chosen title'").count() >= 1
    assert engine.search("garden").first().title == "Bonus Garden Tools"
    assert {r.decision for r in engine.table("decisions").collect()} == {"same_entity"}
    truth = engine.table("links").selectExpr("entity_id", "title", "concat(source_table, ':', source_id) as ref")
    report = engine.evaluate(truth).first()
    assert report.f1 == 1.0 and report.a_recall == 1.0 and report.exact_clusters == report.reference_clusters


def test_wrong_answers_stop_the_run(run):
    engine, found = run
    assert engine.commit_batch(found.run_id, '{"clusters": [')["status"] == "retry_required"
    assert engine.commit_batch(found.run_id, answer(engine, found.run_id, drop=1))["status"] == "retry_required"
    reply = engine.commit_batch(found.run_id, answer(engine, found.run_id, title=" "))
    assert reply["status"] == "invalid_llm_output_stopped" and not reply["has_more"]
    assert engine.commit_batch(found.run_id, answer(engine, found.run_id))["status"] == "stopped"
    assert engine.finalize(found.run_id).first().valid


def test_a_part_of_a_batch_is_committed(run):
    engine, found = run
    given = answer(engine, found.run_id)
    given["clusters"] = given["clusters"][:1]
    reply = engine.commit_batch(found.run_id, given)
    assert reply["status"] == "partial_committed" and reply["next_offset"] == 1 and reply["has_more"]
    assert adjudicate.loop_state(reply) == (1, True, 1)


def test_resolver_goes_through_all_batches(run, spark):
    engine, found = run

    def resolve(members):
        offset = members.agg({"cluster_seq": "min"}).first()[0] - 1
        return spark.createDataFrame([(json.dumps(answer(engine, found.run_id, offset, 1)),)], "answer string")

    done = engine.adjudicate(found.run_id, resolve, limit=1)
    assert done == {"committed_count": 2, "next_offset": 2, "has_more": False, "left": 0, "failures": []}
    assert engine.run_document({"match_run_id": found.run_id})["run_id"] == found.run_id == engine.run_document()["run_id"]


def test_a_resolver_that_runs_out_of_rounds_says_so(run, spark):
    engine, found = run
    one = lambda members: spark.createDataFrame([(json.dumps(answer(engine, found.run_id, members.agg({"cluster_seq": "min"}).first()[0] - 1, 1)),)], "answer string")
    done = engine.adjudicate(found.run_id, one, limit=1, rounds=1)
    assert done == {"committed_count": 1, "next_offset": 1, "has_more": True, "left": 1, "failures": []}


def test_lost_links_come_back_from_the_snapshots(run, spark):
    engine, found = run
    engine.finalize(found.run_id)
    gone = engine.table("links").where("source_id in ('a5', 'b5')").select("source_table", "source_id")
    assert gone.count() == 2
    change = engine.store.change()
    change.upsert("links", engine.table("links").limit(0), ["source_table", "source_id"], deletes=gone)
    change.commit()
    assert engine.table("links").count() == 8 and not engine.quality().first().valid
    quality = engine.finalize(found.run_id).first()
    assert quality.valid and (quality.links_a, quality.links_b) == (5, 5)
    assert engine.table("log").where("operation = 'repair_links'").count() == 2
    assert engine.table("snapshots").count() == 2
    change = engine.store.change()
    rows = engine.table("sources").where("source_table = 'table1'").drop("snapshot")
    assert engine._snapshot(change, rows.repartition(3), "table1") in {r.snapshot for r in engine.table("snapshots").collect()} and "sources" in change.tables
    series = {(r.series, r.label): r.n for r in engine.dashboard()["series"].collect()}
    assert series["source_table", "table1"] == 5 and sum(n for (s, _), n in series.items() if s == "status") == engine.table("entities").count()


def test_review_choices_are_committed(run, spark):
    engine, found = run
    rows = [(0.5, "a5", "b5", "Quicken Home", "Bonus Garden Tools"), (0.4, "a1", "b1", "L", "R")]
    task = engine.create_review(spark.createDataFrame(rows, "confidence double, l_id string, r_id string, l_title string, r_title string"))
    assert [r.position for r in engine.review_page(task, 1, 1).collect()] == [0]
    assert engine.submit_review(task, spark.createDataFrame([(0, "table2"), (1, "skip")], "position long, choice string")) == 1
    owners = {(r.source_table, r.source_id): r.entity_id for r in engine.table("links").where("source_id in ('a5', 'b5')").collect()}
    # Both are linked already; the choice renames the first owner and tells of the conflict.
    assert engine.table("entities").where("canonical_title = 'Bonus Garden Tools'").count() == 2 and len(owners) == 2
    assert engine.table("log").where("operation = 'entity_link_conflict'").count() == 1
    assert engine.create_review(spark.createDataFrame([], "confidence double, l_id string, r_id string, l_title string, r_title string")) is None


def test_headers_must_agree_in_order_case_and_characters(spark, tmp_path):
    assert profile.strict_match(["id", "Title"], ["id", "Title"])
    assert not profile.strict_match(["id", "Title"], ["id", "title"]) and not profile.strict_match(["id", "Title"], ["Title", "id"])
    for name, line in (("x", "id,Beer_Name,Style,ABV\n1,é,b,c\n"), ("y", "id,Beer_Name,Style,ABV\n"), ("z", "id,beer_name,Style,ABV\n")):
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + line.encode())
    plan = Engine(spark, str(tmp_path / "m")).strict_schema(str(tmp_path / "x.csv"), {"path": str(tmp_path / "y.csv")})
    assert plan.confidence == 1.0 and plan.source == "strict_header" and plan.column_roles["ABV"] == "numeric_auxiliary" and plan.ignored_columns == ["id"]
    assert Engine(spark, str(tmp_path / "m")).strict_schema(str(tmp_path / "x.csv"), str(tmp_path / "z.csv")) is None
    frames = [spark.createDataFrame([("1", "Ale", "x")], f"id string, {n} string, style string") for n in ("beer_name", "Beer_Name")]
    assert profile.analyze(frames[0], frames[0]).reason == "the same headers in the same order"
    assert profile.analyze(*frames).reason != "the same headers in the same order"


def test_tables_of_other_kinds_do_not_match(spark, tmp_path):
    one = spark.createDataFrame([("1", "Deep sets", "Acme", "3", "software")], COLS + ", type string")
    two = spark.createDataFrame([("1", "Deep sets", "Acme", "3", "garden")], COLS + ", type string")
    with pytest.raises(SchemaMismatch, match="kinds differ"):
        Engine(spark, str(tmp_path)).resolve(one, two)


def test_files_in_other_encodings(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,title\n1,caf\xe9\n2,N/A\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "l.csv")).collect()] == [("1", "café"), ("2", None)]
    assert tables.read_csv(spark, {"url": str(tmp_path / "l.csv")}, limit=1).count() == 1
    assert tables.read_header(spark, str(tmp_path / "l.csv")) == ["id", "title"]
    (tmp_path / "d" / "s").mkdir(parents=True)
    for n in ("tableA.csv", "tableB.csv"):
        (tmp_path / "d" / "s" / n).write_text("id\n1\n")
    assert [x.rsplit("/", 1)[1] for x in tables.discover_datasets(spark, str(tmp_path / "d"))] == ["s"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text("{bad"), (tmp_path / "r" / "b.json").write_text('{"f1": 1}')
    assert [r.text for r in tables.latest_reports(spark, str(tmp_path / "r" / "*.json")).collect()] == ['{"f1": 1}']


def test_duplicate_aliases_merge_to_the_end(spark):
    ids = [f"e{i}" for i in range(4)]
    entities = spark.createDataFrame([(i, f"Title number {i}", "Acme", 10.0, "backend_active", 0.5) for i in ids], "entity_id string, canonical_title string, manufacturer string, price double, status string, confidence double")
    chain = [(ids[k + j], f"Shared {k}", f"shared name {k}", "table1", f"{k}-{j}") for k in range(3) for j in (0, 1)]
    aliases = spark.createDataFrame(chain, "entity_id string, alias_title string, normalized_title string, source_table string, source_id string")
    links = aliases.select("entity_id", "source_table", "source_id")
    merged, moved, linked = golden.merge_duplicate_aliases(entities, aliases, links)
    assert [r.entity_id for r in merged.collect()] == ["e0"]
    assert {r.entity_id for r in moved.collect()} == {r.entity_id for r in linked.collect()} == {"e0"}


def test_members_fill_the_sides(spark):
    rows = [("c", None, "llm", None, "", [("table2", "1", "Long title here", "M", "3", {"x": "y"}), ("table1", "7", "Short", None, None, None), ("table2", "2", "x", None, None, None)])]
    df = spark.createDataFrame(rows, f"cand_id string, title string, source string, confidence double, reason string, members array<{commit.MEMBER}>").selectExpr("*", f"cast(null as {commit.SCORES}) as scores")
    got = commit.candidates_from_members(df).first()
    assert (got.title, got.confidence, got.table1.id, got.table2.id, got.table2.manufacturer, got.table2.attributes) == ("Long title here", 0.9, "7", "1", "M", {"x": "y"})
    assert [(r.source_table, r.source_id) for r in commit.source_refs(commit.candidates_from_members(df)).orderBy("pos").collect()] == [("table2", "1"), ("table1", "7"), ("table2", "2")]


def test_weights_are_tuned_by_brute_force(spark):
    rows = [(i % 3 == 0, (i * 37 % 100) / 100, (i * 11 % 50) / 50) for i in range(80)]
    df = spark.createDataFrame([(int(y), a, b) for y, a, b in rows], "label int, a double, b double")
    got = evaluation.tune_weights(df, ["a", "b"], step=10).first()
    best = 0.0
    for w, v in evaluation.weight_grid(["a", "b"], 10):
        for t in range(5, 96):
            hit = [0.0 + w * a + v * b >= t / 100 for _, a, b in rows]
            tp = sum(h and y for h, (y, *_) in zip(hit, rows, strict=True))
            best = max(best, 2 * tp / (sum(hit) + sum(y for y, *_ in rows)))
    assert got.f1 == pytest.approx(best, abs=1e-6)
    assert len(evaluation.weight_grid(["a", "b", "c", "d"])) == 1771


def test_cards(spark, tmp_path):
    a = spark.createDataFrame([("1", "Pale Ale", "5 %"), ("2", "Stout", "4.2 %")], "id string, Beer_Name string, ABV string")
    got = cards.dataset_cards("beers", a, a.limit(1), cards.split_statistics("train", spark.createDataFrame([("1",), ("0",), ("0",)], "gold string")))
    by = {r.field: r for r in got.collect()}
    assert by["ABV"].recommended_match_method == cards.METHODS["number"] and by["ABV"].data_type == "numeric" and by["id"].importance is None
    assert by["Beer_Name"].entity_type == "beer" and "Compare first: Beer_Name, ABV" in by["id"].knowledge_text and "train: 1 positive, 2 negative" in by["id"].knowledge_text
    cards.write_cards(got, str(tmp_path / "cards"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cards" / "csv")).count() == 3
    assert cards.label_column(spark.createDataFrame([("5", "1"), ("6", "0")], "x string, y string")) == "y"


def test_models_are_kept_and_read(spark, tmp_path):
    from goldweave.operators.features import FEATURES

    data = spark.createDataFrame([(float(i % 2), *[float((i * (k + 3)) % 7) for k in range(len(FEATURES))]) for i in range(40)], "label double, " + ", ".join(f"{f} double" for f in FEATURES))
    model = scoring.train_gbt(data, rounds=3)
    scoring.save_models(str(tmp_path / "m"), {"gbt": model}, {"f1": 0.5})
    models, metrics = feature_model.load(spark, str(tmp_path / "m"))
    assert metrics == {"f1": 0.5} and models["mlp"] is None and models["features"] is None
    one, two = (sorted(r.s for r in scoring.probability(m, data, "s").collect()) for m in (model, models["gbt"]))
    assert one == two
    assert feature_model.load(spark, str(tmp_path / "none")) == ({"features": None, "gbt": None, "mlp": None}, {})


BEER = "id string, Beer_Name string, Brew_Factory_Name string, Style string, ABV string"


def test_every_planned_column_reaches_the_master(spark, tmp_path):
    a = [("1", "Red Barn Amber Ale", "Red Barn Brewing", "Amber Ale", "5.20 %"), ("2", "Cask Works Porter", "Cask Works", "Porter", "-")]
    b = [("1", "Red Barn Amber Ale", "Red Barn Brewing Co.", "American Amber", ""), ("9", "Lone Lager", "Peak", None, "4.1 %")]
    engine = Engine(spark, str(tmp_path))
    run = engine.resolve(spark.createDataFrame(a, BEER), spark.createDataFrame(b, BEER))
    for _ in range(2):  # before the golden table is made from the entities, and after
        view = {r.Beer_Name: r for r in engine.master().collect()}
        assert set(engine.master().columns) == {"id", "Beer_Name", "Brew_Factory_Name", "Style", "ABV", "status", "selected_source_table", "confidence"}
        assert view["Cask Works Porter"].Brew_Factory_Name == "Cask Works" and view["Cask Works Porter"].ABV == "-"
        red = view["Red Barn Amber Ale"]
        assert (red.Brew_Factory_Name, red.Style, red.ABV) == ("Red Barn Brewing", "Amber Ale", "5.20 %")
        assert view["Lone Lager"].Style is None and view["Lone Lager"].ABV == "4.1 %"
        engine.finalize(run.run_id)
    held = {r.canonical_title: r.attributes for r in engine.table("entities").collect()}
    assert held["Lone Lager"] == {"Beer_Name": "Lone Lager", "Brew_Factory_Name": "Peak", "ABV": "4.1 %"}
    later = engine.resolve_incremental(spark.createDataFrame([("7", "Late Stout", "Night", "Stout", "6 %")], BEER))
    engine.finalize(later.run_id)
    assert [(r.Style, r.ABV) for r in engine.master().where("Beer_Name = 'Late Stout'").collect()] == [("Stout", "6 %")]
    assert engine.repair(spark.createDataFrame([("8", "Lost Pils", "Dale", "Pils", "")], BEER), "table2") == 1
    assert engine.master().where("Beer_Name = 'Lost Pils'").first().Style == "Pils"


def test_restaurants_keep_their_columns(spark, tmp_path):
    names = "id string, title string, addr string, city string, phone string, type string"
    a = spark.createDataFrame([("1", "Chez Anna", "5 Main St", "Oslo", "555-1000", "french"), ("2", "Delta Grill", "1 Hill Rd", "Rome", "555-2000", "sushi")], names)
    b = spark.createDataFrame([("4", "Chez Anna", "5 Main Street", "Oslo", "555 1000", "bistro"), ("5", "Sushi Go", "9 Bay", "Kobe", "555-3000", "sushi")], names)
    engine = Engine(spark, str(tmp_path))
    engine.resolve(a, b)
    assert engine.specs()[0] == ("name", "title")
    view = {r["name"]: r for r in engine.master().collect()}
    assert {"name", "addr", "city", "phone", "type"} < set(engine.master().columns)
    assert view["Chez Anna"].addr == "5 Main St" and view["Sushi Go"].phone == "555-3000" and len(view) == 3


def test_golden_records_hold_raw_makers(spark, tmp_path):
    a = spark.createDataFrame([("a1", "Red barn amber ale kit", "Red Barn Brewing", "5"), ("a2", "Office Visio Standard 2007", "MS", "9")], COLS)
    b = spark.createDataFrame([("b1", "Red barn amber ale kit", "Red Barn Brewing", "5"), ("b2", "Office Visio Standard 2007", "Microsoft", "9"), ("b3", "Cask Works porter kit", "Cask Works", "7")], COLS)
    engine = Engine(spark, str(tmp_path))
    run = engine.resolve(a, b)
    engine.finalize(run.run_id)
    makers = {r.title: r.manufacturer for r in engine.golden().collect()}
    assert makers == {"Red barn amber ale kit": "Red Barn Brewing", "Office Visio Standard 2007": "MS", "Cask Works porter kit": "Cask Works"}
    assert {r.manufacturer for r in engine.table("links").collect()} == {"Red Barn Brewing", "MS", "Microsoft", "Cask Works"}


def test_merged_entities_fill_each_others_attributes(spark):
    kind = "entity_id string, canonical_title string, manufacturer string, price double, status string, confidence double, attributes map<string,string>"
    rows = [("e1", "Long enough title", None, None, "s", 0.5, {"x": "1", "y": " "}), ("e2", "long enough title", "M", 2.0, "s", 0.7, {"y": "2", "x": "9"}), ("e3", "Another title here", None, None, "s", 0.5, None)]
    e = spark.createDataFrame(rows, kind)
    none = spark.createDataFrame([], "entity_id string, alias_title string, normalized_title string, source_table string, source_id string")
    merged, _, _ = golden.merge_entities(e, none, none.select("entity_id", "source_table", "source_id"), golden.duplicate_titles(e))
    assert {r.entity_id: r.attributes for r in merged.collect()} == {"e1": {"x": "1", "y": "2"}, "e3": None}


def test_the_gate_and_its_branches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "m"))
    papers = spark.createDataFrame([("1", "Deep sets", "A. B", "VLDB", "2001")], "id string, title string, authors string, venue string, year string")
    goods = spark.createDataFrame(A, COLS)
    refused = engine.ingest(goods, papers)
    assert refused["status"] == "reupload_required" and refused["gate"] == "schema_judged" and engine.store.read("runs") is None
    assert engine.ingest(goods, goods.withColumnRenamed("manufacturer", "Maker"), judge=lambda plan: False)["status"] == "reupload_required"
    reply = engine.ingest(goods, spark.createDataFrame(B, COLS))
    assert (reply["gate"], reply["status"], reply["next"]) == ("strict_schema_matched", "llm_required", "adjudicate")
    assert engine.run_document()["run_id"] == reply["match_run_id"]
    engine.finalize(reply["match_run_id"])
    truth = engine.table("links").selectExpr("case when source_id = 'a5' then 'other' else entity_id end as entity_id", "title", "concat(source_table, ':', source_id) as ref")
    engine.report(truth.where("ref <> 'table2:b5'"), str(tmp_path / "r"))
    rows = tables.read_csv(spark, str(tmp_path / "r" / "mismatches"))
    assert rows.columns == ["side", "refs", "reference_title", "predicted_entity_id", "predicted_title"] and {r.side for r in rows.collect()} == {"extra_predicted_cluster"}
    assert spark.read.json(str(tmp_path / "r" / "report")).count() == 1


def test_written_fields_are_fixed(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("1", "x", "y")], "id string, extra string, title string").coalesce(1), str(tmp_path / "o"), ["id", "title", "price"], mark=True)
    text = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("\ufeffid,title,price\n1,y,")
