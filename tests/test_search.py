import random

from pyspark.sql import functions as F

from goldweave.operators import golden, search_index
from goldweave.sources.store import Store

RECORDS = "entity_id string, title string, aliases array<string>, confidence double"


def records(spark, n=150):
    rng = random.Random(2)
    part = lambda: rng.choice(["red", "Red Widget", "blue", "X-ray", "acme", "pro 7", "微软 Office", "zz", "", "go"])
    rows = [(f"e{i:03d}", " ".join(part() for _ in range(rng.randint(0, 3))), [part() for _ in range(rng.randint(0, 2))], rng.choice([0.5, 0.7, 0.9, None])) for i in range(n)]
    rows += [("x1", None, None, 0.4), ("x2", "!!", ["?"], 0.9)]
    return spark.createDataFrame(rows, RECORDS)


def test_the_index_answers_as_the_scan_does(spark, tmp_path):
    table = records(spark)
    store = Store(spark, str(tmp_path))
    search_index.build(table, ["title", "aliases"]).save(store)
    index = search_index.SearchIndex.load(store)
    asked = ["red widget", "Red", "rw", "x", "微软", "wed", "dwerid", "7orp", "acme pro", "q", "", "!", "zzzz", "go", "edr", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for limit, places in ((3, (5, 40)), (12, (1,)), (100, ())):
        got = {}
        for r in search_index.search_all(index, queries, limit=limit, places=places).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.entity_id, r.score))
        for k, q in enumerate(asked):
            want = [(r.entity_id, r.score) for r in golden.search(table, q or "", ["title", "aliases"], limit=limit).collect()]
            assert got.get(k, []) == want, (q, limit)
    assert search_index.search_all(index, queries.limit(0)).count() == 0
    assert search_index.search_all(search_index.build(table.limit(0), ["title"]), queries).count() == 0


def test_an_index_touches_few_records(spark):
    """The postings that a name is verified on grow with its own grams, not with the records."""
    rows = [(f"e{i:05d}", f"serial number {i:05d}", None, 1.0 - i / 10_000) for i in range(2_000)]
    index = search_index.build(spark.createDataFrame(rows, RECORDS), ["title"])
    asked = spark.createDataFrame([(i, f"number {i:05d}") for i in range(0, 2_000, 100)], "query_id int, query string").select("query_id", search_index.compact(F.col("query")).alias("q"))
    by = search_index._rarest(asked, index.sizes, "c", F.lit(3))
    assert by.count() == 20 and by.join(index.grams.where("kind = 'c'"), "gram").count() < 0.05 * 20 * 2_000
    best = search_index.search_all(index, asked.select("query_id", F.col("q").alias("query")), limit=1).collect()
    assert sorted((r.query_id, r.entity_id, r.score) for r in best) == [(i, f"e{i:05d}", 0.86) for i in range(0, 2_000, 100)]


def test_copies_of_records_add_no_comparisons(spark):
    """Queries meet different texts and sets of characters; copies only wait behind the first of their text."""
    names = ["red ring", "blue gear", "red gear", "grid beer"]
    table = lambda n: spark.createDataFrame([(f"e{i:04d}", names[i % 4], None, (i * 7 % 10) / 10) for i in range(n)], RECORDS)
    few, many = (search_index.build(table(n), ["title"]) for n in (40, 400))
    assert few.grams.count() == many.grams.count()
    asked = spark.createDataFrame([(1, "rg"), (2, "Red Gear"), (3, "der"), (4, "gear"), (5, "rg"), (6, "grid")], "query_id int, query string")
    got = {}
    for r in search_index.search_all(many, asked, limit=5, places=(30,)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.entity_id, r.score))
    for k, q in asked.collect():
        assert got[k] == [(r.entity_id, r.score) for r in golden.search(table(400), q, ["title"], limit=5).collect()], q
