import random

from pyspark.sql import functions as F

from goldweave.functions import text as T
from goldweave.operators import features, similarity


def titles(rng, n, first):
    word = lambda: rng.choice(["a", "ab", "abc", "bcd", "süß", "x1", "office", "2007", "officer", "offices"])
    return [(first + i, " ".join(word() for _ in range(rng.randint(0, 7))) if rng.random() < 0.95 else None) for i in range(n)]


def test_similarities_against_vectors_of_all_terms(spark):
    """Each pair once for each time it is given, also with terms that were not counted, and the same ids on both sides."""
    rng = random.Random(5)
    left, right, seen = titles(rng, 25, 0), titles(rng, 30, 10), titles(rng, 8, 0)
    sides = [spark.createDataFrame(x, "id long, title_norm string") for x in (left, right)]
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("title_norm").alias(f"{p}_norm"), T.tokens(F.coalesce("title_norm", F.lit(""))).alias(f"{p}_tokens"), F.lit("m").alias(f"{p}_maker"), F.lit(1.0).alias(f"{p}_price"))
    pairs = side(sides[0], "l").crossJoin(side(sides[1], "r"))
    pairs = pairs.unionByName(pairs.where("l_id = 3 and r_id = 12"))
    built = features.FeatureBuilder.fit(spark.createDataFrame(seen, "id long, title_norm string"))
    out = built.transform(pairs)
    assert out.count() == pairs.count() == 25 * 30 + 1
    n, words = built.volumes.first()
    want = pairs.select("l_id", "r_id").distinct()
    for name in ("char", "word"):
        idf = built.counts.where(F.col("kind") == name).select("term", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
        vectors = [features.tfidf_vectors(features.term_counts(x, features.KINDS[name](F.col("title_norm"))), idf) for x in sides]
        want = want.join(features.sparse_dot(pairs.select("l_id", "r_id").distinct(), *vectors, name), ["l_id", "r_id"])
    stats = built.counts.where("kind = 'token'").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.lit(words / n).alias("avg_len"))
    texts = [x.select("id", T.words(F.coalesce("title_norm", F.lit(""))).alias("words")) for x in sides]
    want = want.join(features.bm25_similarity(pairs.select("l_id", "r_id").distinct(), texts[0], stats, texts[1]), ["l_id", "r_id"])
    want = {(r.l_id, r.r_id): (r.char, r.word, r.title_bm25_similarity) for r in want.collect()}
    found = {(r.l_id, r.r_id): (r.char_tfidf_cosine, r.word_tfidf_cosine, r.title_bm25_similarity) for r in out.collect()}
    assert len(want) == 750 and any(v[0] > 0.5 for v in want.values()) and set(found) == set(want)
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(found[k], want[k], strict=True))
    # With the records given the titles are not gathered from the pairs.
    again = {(r.l_id, r.r_id): (r.char_tfidf_cosine, r.word_tfidf_cosine, r.title_bm25_similarity) for r in built.transform(pairs, tuple(sides)).collect()}
    assert again == found


def test_pieces_are_those_of_the_columns(spark):
    rows = titles(random.Random(2), 60, 0)
    df = spark.createDataFrame(rows, "id long, title_norm string").where("title_norm is not null")
    for r in df.select("title_norm", features.pieces(F.col("title_norm")).alias("pieces"), T.char_ngrams(F.col("title_norm")).alias("grams"), T.word_ngrams(F.col("title_norm")).alias("terms")).collect():
        words, terms, _ = similarity._parsed(r.title_norm)
        assert r.pieces == [*words, *[t for t in terms if t not in words]]
        assert sorted(r.terms) == sorted(t for t, n in terms.items() for _ in range(n))
        assert sorted(r.grams) == sorted(g for w, n in words.items() for _ in range(n) for g in similarity._grams(w))
