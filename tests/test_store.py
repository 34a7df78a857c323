import json
import os

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from goldweave.operators import blocking, feature_model, features, prepare
from goldweave.plans.engine import Engine
from goldweave.sources.store import Conflict, Store
from goldweave.streaming.incremental import resolve_stream

COLS = "id string, title string, manufacturer string, price string"
KV = "k int, v string"


def held(store, name="t"):
    return sorted(tuple(r) for r in store.read(name).collect())


def files(store):
    return {n for e in store.manifest()["tables"].values() for ps in e["parts"].values() for n in ps}


def test_changes_become_visible_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None and store.version("t") == 0
    store.write("t", spark.createDataFrame([(i, "a") for i in range(20)], KV), ["k"])
    change = store.change()
    change.upsert("t", spark.createDataFrame([(3, "b"), (99, "c")], KV), ["k"])
    change.append("log", spark.createDataFrame([("x",)], "line string"))
    # Until the manifest is swapped, as after a lost job, nothing has changed.
    assert held(store) == [(i, "a") for i in range(20)] and store.read("log") is None
    assert held(Store(spark, str(tmp_path))) == held(store)
    other = store.change()
    other.append("log", spark.createDataFrame([("y",)], "line string"))
    change.commit()
    assert dict(held(store))[3] == "b" and dict(held(store))[99] == "c" and store.read("log").count() == 1
    with pytest.raises(Conflict):
        other.commit()
    assert store.read("log").first().line == "x" and store.version("t") == store.version("log") == 2
    assert store.vacuum() >= 1 and len(held(store)) == 21  # the loser's rows
    assert not [n for n in os.listdir(tmp_path / "manifests") if "draft" in n]


def test_an_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket_rows=10)
    store.write("t", spark.createDataFrame([(i, "a") for i in range(400)], KV), ["k"])
    store.compact("t")
    entry = store.manifest()["tables"]["t"]
    assert entry["buckets"] == 40
    before = files(store)
    change = store.change()
    change.upsert("t", spark.createDataFrame([(7, "b")], KV), ["k"], deletes=spark.createDataFrame([(8,), (5000,)], "k int"))
    change.commit()
    new = files(store) - before
    assert len(new) <= 3
    written = spark.read.parquet(*[f"{tmp_path}/{p}" for p in new]).count()
    assert written <= 3 * 30
    assert dict(held(store)) == {i: "b" if i == 7 else "a" for i in range(400) if i != 8}
    assert store.read("t", spark.createDataFrame([(7,)], "k int")).count() <= 30
    change = store.change()
    change.insert("t", spark.createDataFrame([(7, "z"), (8, "n"), (8, "n")], KV), ["k"])
    change.commit()
    assert dict(held(store))[7] == "b" and dict(held(store))[8] == "n" and len(held(store)) == 400


def test_columns_may_be_added_and_folders_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(5):
        change = store.change()
        change.append("t", spark.createDataFrame([(i, f"v{i}", {"n": str(i)})], KV + ", more map<string,string>") if i else spark.createDataFrame([(0, "v0")], KV))
        change.commit()
    want = [(0, None), *[(i, {"n": str(i)}) for i in range(1, 5)]]
    assert sorted((r.k, r.more) for r in store.read("t").collect()) == want
    assert store.maintain(most=4) == ["t"] and store.maintain(most=4) == []
    assert sorted((r.k, r.more) for r in store.read("t").collect()) == want and len(files(store)) == 1
    assert store.vacuum(keep=1) == 5 and len(os.listdir(tmp_path / "data")) == 1 and len([n for n in os.listdir(tmp_path / "manifests") if n.endswith(".json") and not n.startswith(".")]) == 1
    json.dumps(store.manifest())


def test_a_lost_commit_leaves_the_master_whole(spark, tmp_path, monkeypatch):
    rows = [("a1", "Norton Antivirus 2007", "Symantec", "20"), ("a2", "Acme Photo Studio", "Acme", "50")]
    engine = Engine(spark, str(tmp_path))
    engine.resolve(spark.createDataFrame(rows, COLS), spark.createDataFrame([("b1", "Norton Antivirus 2007", "Symantec", "20")], COLS))
    before = {n: sorted(map(repr, engine.table(n).collect())) for n in ("entities", "golden", "links", "aliases", "decisions", "log", "runs", "waiting")}
    from goldweave.sources import store as module

    put = module.Change._put
    calls = []

    def lost(self, entry, df):
        calls.append(1)
        if len(calls) == 4:  # between two tables
            raise RuntimeError("lost")
        return put(self, entry, df)

    monkeypatch.setattr(module.Change, "_put", lost)
    more = spark.createDataFrame([("c1", "Quicken Home", "Intuit", "9")], COLS)
    with pytest.raises(RuntimeError, match="lost"):
        engine.resolve_incremental(more)
    monkeypatch.setattr(module.Change, "_put", put)
    assert {n: sorted(map(repr, engine.table(n).collect())) for n in before} == before
    engine.resolve_incremental(more)
    assert engine.table("links").count() == 4


def statistics(builder):
    counts = {(r.kind, r.term): r.df for r in builder.counts.groupBy("kind", "term").agg(F.sum("df").alias("df")).collect()}
    return counts, tuple(builder.volumes.agg(F.sum("n_docs"), F.sum("words")).first())


def test_statistics_of_batches_add_up(spark, tmp_path):
    titles = [f"word{i % 3} item {i} pack{i % 5}" for i in range(12)]
    rows = [(f"r{i}", t, f"maker {i}", str(10 + i)) for i, t in enumerate(titles)]
    engine = Engine(spark, str(tmp_path))
    engine.resolve(spark.createDataFrame(rows[:3], COLS), spark.createDataFrame(rows[3:6], COLS))
    for k, batch in enumerate((rows[6:8], rows[8:12], rows[8:12])):
        engine.resolve_incremental(spark.createDataFrame(batch, COLS), epoch=f"e{min(k, 1)}")  # the last one is a repeated epoch
    whole = features.FeatureBuilder.fit(prepare.preprocess(spark.createDataFrame(rows, COLS)))
    assert statistics(engine.title_statistics()) == statistics(whole)
    change = engine.store.change()
    engine._count_titles(change, "e1", prepare.preprocess(spark.createDataFrame(rows, COLS)))
    change.commit()
    engine.maintain()
    assert statistics(engine.title_statistics()) == statistics(whole)


def labeled(spark, n=40):
    rows = [(f"l{i}", f"Title {i % 7} part {i}", "Acme", str(i), f"r{i}", f"Title {i % 7} part {i if i % 2 else i + 1}", "Acme", str(i if i % 2 else 2 * i + 9), float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "l_id string, l_title string, l_manufacturer string, l_price string, r_id string, r_title string, r_manufacturer string, r_price string, label double")


def values(df):
    return sorted((r.l_id, r.r_id, *[None if r[f] is None else round(r[f], 9) for f in features.FEATURES]) for r in df.collect())


def test_a_reloaded_bundle_gives_the_same_features(spark, tmp_path):
    engine, pairs = Engine(spark, str(tmp_path / "m")), labeled(spark)
    metrics = engine.train(pairs, pairs, str(tmp_path / "b"), gbt_rounds=3, mlp_rounds=20)
    assert set(metrics) == {"roc_auc", "average_precision", *[f"{m}_at_0_{k}" for m in ("precision", "recall", "f1") for k in (9, 5)]} and metrics["roc_auc"] > 0.9
    ready = blocking.pair_sides(pairs)
    models, told = feature_model.load(spark, str(tmp_path / "b"))
    assert told == metrics and all(models.values())
    assert values(models["features"].transform(ready)) == values(feature_model.TitleFeatures().fit(ready).transform(ready))
    # The statistics are those of the training, whatever pairs are asked about.
    few = ready.limit(3)
    assert values(models["features"].transform(few)) != values(feature_model.TitleFeatures().fit(few).transform(few))
    assert feature_model.score(few, models)[1] is False
    # A bundle without its features, and one whose tables are lost, fit them anew on the pairs.
    assert feature_model.score(few, models | {"features": None})[1] is True
    for n in ("counts", "volumes"):
        for f in (tmp_path / "b" / "features" / n).glob("*"):
            f.unlink()
    lost, _ = feature_model.load(spark, str(tmp_path / "b"))
    out, refitted = feature_model.score(few, lost)
    assert refitted and values(out) == values(feature_model.TitleFeatures().fit(few).transform(few))


def test_features_are_a_stage_of_a_pipeline(spark, tmp_path):
    ready = blocking.pair_sides(labeled(spark, 12))
    fitted = Pipeline(stages=[feature_model.TitleFeatures()]).fit(ready)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    assert values(PipelineModel.load(str(tmp_path / "p")).transform(ready)) == values(fitted.transform(ready))
    with pytest.raises(ValueError, match="lack"):
        fitted.transform(ready.drop("l_norm"))


def test_a_stream_scores_by_a_bundle_and_repeats_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "m"))
    engine.resolve(spark.createDataFrame([("a1", "Norton Antivirus 2007", "Symantec", "20")], COLS), spark.createDataFrame([("b1", "Norton Antivirus 2007", "Symantec", "20")], COLS))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("id,title,manufacturer,price\nc1,Quicken Home,Intuit,9\n")
    epochs = []
    for k in range(2):
        stream = spark.readStream.schema(COLS).option("header", True).csv(str(tmp_path / "in"))
        resolve_stream(stream, engine, str(tmp_path / f"ck{k}"), after=lambda run, epoch: epochs.append((epoch, run.refitted))).awaitTermination(120)
    assert epochs == [(0, False), (0, False)] and engine.table("links").count() == 3
    assert statistics(engine.title_statistics())[1] == (3, 8)
