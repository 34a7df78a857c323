"""Fill-in-the-middle, centroid clustering and token counts against brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from goldweave.llm import annulus, fill_in_middle, queries, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, n string, form int, units string, h1 string, digest string, counts string, n_bytes string"
BITS = ["a", "the", " ", "  ", "\n", "\t", "\x0b", "'re", "'ll", "'s", "'", "é", "́", "日本", "😀", "12", "!", "...", "<|endoftext|>", "<|endof", "|>", "\xa0", "　", "Привет", "\x00", "\x1c", "՘", " re", "-----", "    ", "\r\n", "<P>", "<S", ">"]


def texts(seed, n=250):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def odd_rows():
    return [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "two words"), (904, "two words"), (905, "x" * 200_000), (906, "word " * 60_000), (907, " " * 100_000), (None, "no id"), (908, "has <M> inside")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ---- 11 ------------------------------------------------------------------------


def arranged(i, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_brute_force(spark):
    rows = odd_rows() + list(enumerate(texts(1)))
    made = fill_in_middle.fill_in_middle(docs_of(spark, rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    assert got == sorted((arranged(*r) for r in rows), key=repr)
    assert sorted((r.doc_id or -1, r.back) for r in made) == sorted((i or -1, t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_other_parameters(spark):
    rows = list(enumerate(texts(2, 60)))
    marks = ("<pre>", "<suf>", "<mid>")
    made = fill_in_middle.fill_in_middle(docs_of(spark, rows), seed=7, rate=100, spm_rate=0, sentinels=marks)
    made = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in made} == {"psm", "plain"} and {r.doc_id: r.back for r in made} == dict(rows)
    assert all((r.form == "plain") == (r.back == "") for r in made)
    for wrong in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S><", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs_of(spark, rows), sentinels=wrong)


def test_fill_in_middle_plan_and_names(spark):
    df = spark.createDataFrame([(1, "a b c", "n", 1, "u", "h", "d", "c", "b")], CLASH)
    made = fill_in_middle.fill_in_middle(df)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert tuple(made.first()) == arranged(1, "a b c")
    assert made.where("false").count() == 0 and fill_in_middle.fill_in_middle(df.limit(0)).count() == 0
    plan = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all(") == 1  # the units are made once


# ---- 12 ------------------------------------------------------------------------


def clustered(rows, dimension=64, clusters=40, rounds=5):
    """Plain rounds in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and abs(x) < 2**19 for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    key = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in key[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, k in found:
        per[k] = per.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, per[k], sum(per.values()), digest[k]) for i, d, k in found), key=repr)


def got_rows(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)]) for i in range(180)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[9][1]), (None, rows[11][1])]
    bad = [(500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [0.5] * 63 + [None]), (505, [0.5] * 63 + [float("nan")]), (506, [float("-inf")] + [0.5] * 63), (507, [1e9] * 64)]
    rows += bad + [(508, [0.0] * 64), (509, [-(2.0**18)] * 64)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    got = got_rows(annulus.cluster_vectors(df.withColumns({"v": F.lit("clash"), "cluster": F.lit("clash"), "n": F.lit(0), "distance": F.lit("x")}).repartition(5)))
    assert got == clustered(rows)
    assert not {r[0] for r in got} & {i for i, _ in bad}


def test_clustering_ties_and_few_vectors(spark):
    """Grid vectors are at equal distances from several centroids; fewer vectors than centroids are all centroids."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-1, 2)) / 256 for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = got_rows(annulus.cluster_vectors(df, dimension=3, clusters=9, rounds=3))
    assert got == clustered(rows, 3, 9, 3)
    few = rows[:4] + rows[:2]
    assert got_rows(annulus.cluster_vectors(spark.createDataFrame([(i, v, 0) for i, v in few], VECTORS), dimension=3)) == clustered(few, 3)
    same = [(i, [1.0] * 3) for i in range(50)]
    assert got_rows(annulus.cluster_vectors(spark.createDataFrame([(i, v, 0) for i, v in same], VECTORS), dimension=3)) == clustered(same, 3)
    none = annulus.cluster_vectors(df.limit(0), dimension=3)
    assert none.count() == 0 and none.columns == annulus.cluster_vectors(df, dimension=3).columns
    assert annulus.cluster_vectors(df, dimension=64).count() == 0


def test_annulus_compares_few_where_norms_differ_and_loses_none():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-40, 40, (400, 6)) * rng.integers(1, 400, (400, 1))
    centroids[50:60] = centroids[40:50]  # equal centroids: the smaller number wins
    vectors = np.concatenate((centroids[rng.integers(0, 400, 3000)] + rng.integers(-9, 9, (3000, 6)), centroids, -centroids[:50]))
    search = annulus.Annulus(centroids)
    own, far = search.nearest(vectors)
    exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (own == exact.argmin(1)).all() and (far == exact.min(1)).all()
    assert search.compared < 0.5 * exact.size
    empty = search.nearest(vectors[:0])
    assert len(empty[0]) == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_centroid_clustering"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and len(want) > 0


# ---- 13 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(queries.tokenizer_path("byte_bpe_50k.json"))


def test_every_prefix_counts_as_the_tokenizer_does(counter):
    for t in [*texts(3, 400), "don't you'll we've they're 'v 'll", "a  b   c \n d\n\ne", "<|endoftext|>", "  <|endoftext|>  <|endoftext|><|endoftext|>x"]:
        want = [len(counter.tokenizer.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == want, t


def test_characters_that_the_tokenizer_classes_otherwise(counter):
    for c in "՘֋౜₏͸﷐\U000107bb᠎​\x85\x1f":
        for t in (f"a{c}b", f"1{c} {c}", f" {c}{c}!"):
            assert counter.prefixes(t)[-1] == len(counter.tokenizer.encode(t, add_special_tokens=False).ids)


def test_tables_of_bounded_size_change_nothing():
    small, rows = token_counts.PrefixCounter(queries.tokenizer_path("byte_bpe_50k.json"), capacity=5), texts(9, 80)
    want = [len(small.tokenizer.encode(t, add_special_tokens=False).ids) for t in rows]
    assert [int(small.prefixes(t)[-1]) for t in rows] == want
    assert len(small.held) <= 5 and len(small.pairs) <= 20


def test_counts_over_tables(spark, counter):
    rows = odd_rows() + list(enumerate(texts(5, 120)))
    want = {(i, len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    path = queries.tokenizer_path("byte_bpe_50k.json")
    df = docs_of(spark, rows).withColumns({"counts": F.lit("clash"), "n_tokens": F.lit(1)})
    held = token_counts.prefix_counts(df, path)
    assert {tuple(r) for r in held.select("doc_id", "n_bytes", "n_tokens").collect()} == want
    got = token_counts.count_tokens(df, path, limit=7).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 7) for r in got)
    asked = held.select("doc_id", token_counts.longest_within(F.col("counts"), 7).alias("fits"), token_counts.tokens_at(F.col("counts"), 5).alias("five")).collect()
    assert sorted((r.doc_id or -1, r.fits) for r in asked) == sorted((r.doc_id or -1, r.fits_chars) for r in got)
    by_id = {i: t or "" for i, t in rows}
    for r in asked:
        size = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
        t = by_id[r.doc_id]
        assert size(t[: r.fits]) <= 7 and r.five == size(t[:5])
        assert all(size(t[:k]) > 7 for k in range(r.fits + 1, min(len(t), 60) + 1))
    assert held.where("false").count() == 0 and token_counts.count_tokens(df.limit(0), path).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(queries.tokenizer_path("word_bpe_49k.json"))


def test_counts_of_the_test_documents(spark, sf, counter):
    rows = {r.doc_id: r for r in queries.op13_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert rows[r.doc_id].n_tokens == len(counter.tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert len(rows) >= 200
