"""Named queries over the sample tables, each with the SQL that gives the same rows.

Documents play both sources: even ids are the left table and odd ids the right
one; title is the first 80 characters, manufacturer the source, price the
number of characters.  Titles are the column that the queries on ``records``
compare, so those read the first line of a text and not the whole of it.
Labels play the labeled pairs, parts the products, customers and suppliers the
entities and their links.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.functions import numeric as N
from goldweave.functions import text as T
from goldweave.functions.jsontext import json_value
from goldweave.operators import adjudicate, blocking, cards, evaluation, features, golden, graph, prepare, scoring
from goldweave.operators import search_index as indexed
from goldweave.plans import profile
from goldweave.streaming.incremental import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments ----------------------------------------------------------


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def ratio(l: str, r: str, value: str) -> str:  # noqa: E741
    return f"CASE WHEN len({l}) = 0 AND len({r}) = 0 THEN 1.0 WHEN len({l}) = 0 OR len({r}) = 0 THEN 0.0 ELSE {value} END"


def jac(l: str, r: str) -> str:  # noqa: E741
    c = f"len(list_intersect({l}, {r}))"
    return ratio(l, r, f"CAST({c} AS DOUBLE) / (len({l}) + len({r}) - {c})")


RECORDS = f"""docs AS (SELECT doc_id AS id, {norm("substr(text, 1, 80)")} AS t, {norm("source")} AS m, CAST(n_chars AS DOUBLE) AS p FROM documents),
rec AS (SELECT *, {toks("t")} AS k FROM docs), a AS (SELECT * FROM rec WHERE id % 2 = 0), b AS (SELECT * FROM rec WHERE id % 2 = 1)"""
ADJACENT = f"WITH {RECORDS}, pr AS (SELECT a.id AS l_id, b.id AS r_id, a.t AS lt, b.t AS rt, a.m AS lm, b.m AS rm, a.p AS lp, b.p AS rp, a.k AS lk, b.k AS rk FROM a JOIN b ON a.id + 1 = b.id)"
BLOCKED = f"""WITH {RECORDS},
cap AS (SELECT greatest(25, CAST(floor(count(*) * 0.08) AS BIGINT)) AS c FROM b),
lt AS (SELECT id, unnest(k) AS x FROM a), rt AS (SELECT id, unnest(k) AS x FROM b),
rare AS (SELECT x FROM rt GROUP BY x HAVING count(*) <= (SELECT c FROM cap)),
cand AS (SELECT DISTINCT lt.id AS l_id, rt.id AS r_id FROM lt JOIN rt ON lt.x = rt.x WHERE lt.x IN (SELECT x FROM rare)),
rough AS (SELECT l_id, r_id, {jac("a.k", "b.k")} AS s, a.t AS lt, b.t AS rt, a.m AS lm, b.m AS rm, a.p AS lp, b.p AS rp FROM cand JOIN a ON l_id = a.id JOIN b ON r_id = b.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY s DESC, r_id) AS rk FROM rough WHERE s >= 0.18) WHERE rk <= 40)"""
CONFLICT = "(lm <> '' AND rm <> '' AND lm <> rm) OR abs(lp - rp) / greatest(lp, rp, 1.0) > 0.35"
SCORED = f"{BLOCKED}, sc AS (SELECT l_id, r_id, round(s, 9) AS c, coalesce({CONFLICT}, false) AS x FROM top)"
MARGINS = f"""{SCORED}, mg AS (SELECT *,
  row_number() OVER (PARTITION BY l_id ORDER BY c DESC, r_id) AS l_rank, c - coalesce(lead(c) OVER (PARTITION BY l_id ORDER BY c DESC, r_id), -1.0) AS l_margin,
  row_number() OVER (PARTITION BY r_id ORDER BY c DESC, l_id) AS r_rank, c - coalesce(lead(c) OVER (PARTITION BY r_id ORDER BY c DESC, l_id), -1.0) AS r_margin FROM sc)"""
MUTUAL = f"{MARGINS}, mb AS (SELECT * FROM mg WHERE l_rank = 1 AND r_rank = 1 AND l_margin >= 0.04 AND r_margin >= 0.04 AND c >= 0.59 AND c < 0.94 AND NOT x)"
RETAINED = f"{MUTUAL}, rt2 AS (SELECT * FROM sc WHERE c >= 0.59 AND l_id NOT IN (SELECT l_id FROM mb) AND r_id NOT IN (SELECT r_id FROM mb))"
COMPONENTS = f"""{RETAINED.replace("WITH ", "WITH RECURSIVE ", 1)},
ed AS (SELECT 'l:' || l_id AS u, 'r:' || r_id AS v FROM rt2 UNION SELECT 'r:' || r_id, 'l:' || l_id FROM rt2),
reach(u, v) AS (SELECT u, u FROM ed UNION SELECT r.u, e.v FROM reach r JOIN ed e ON r.v = e.u),
comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u)"""
CLUSTERS = f"""{COMPONENTS},
own AS (SELECT rt2.*, component, row_number() OVER w AS rn, c - lead(c) OVER w AS lead FROM rt2 JOIN comp ON node = 'l:' || l_id WINDOW w AS (PARTITION BY component ORDER BY c DESC, l_id, r_id)),
cl AS (SELECT component, count(DISTINCT l_id) AS nl, count(DISTINCT r_id) AS nr, count(*) AS pair_count, max(c) AS max_confidence,
  coalesce(max(CASE WHEN rn = 1 THEN lead END), 1.0) AS score_margin, bool_or(x) AS conflict, string_agg(DISTINCT CAST(l_id AS VARCHAR), ',') AS ls FROM own GROUP BY component),
cl2 AS (SELECT *, nl > 1 OR nr > 1 OR score_margin < 0.04 AS competition FROM cl),
routes AS (SELECT *, CASE WHEN nl = 1 AND nr = 1 AND NOT competition AND NOT conflict AND max_confidence >= 0.94 THEN 'auto_merge' WHEN max_confidence >= 0.59 THEN 'llm_cluster' ELSE 'different_entity' END AS route FROM cl2)"""


# ---- shared frames ----------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("source").alias("manufacturer"), F.col("n_chars").cast("double").alias("price_norm"))
    out = out.withColumns({"title_norm": T.normalize_text(F.col("title")), "manufacturer_norm": T.normalize_text(F.col("manufacturer"))})
    return prepare.with_tokens(out)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r.where("id % 2 = 0"), r.where("id % 2 = 1")


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(records(spark, sf_dir))


def neighbours(r: DataFrame) -> DataFrame:
    """Pairs of a left record and the right one that follows it."""
    left, right = r.where("id % 2 = 0"), r.where("id % 2 = 1")
    keys = left.select(F.col("id").alias("l_id"), (F.col("id") + 1).alias("r_id"))
    return blocking.with_sides(keys, left, right)


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_records(graph.settled(records(spark, sf_dir)))  # texts are read once


def blocked_records(r: DataFrame) -> DataFrame:
    left, right = r.where("id % 2 = 0"), r.where("id % 2 = 1")
    cap = blocking.posting_cap(right.count())
    return blocking.block_schema(left, right, cap=cap)


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked pairs with the thirteen features."""
    r = graph.settled(records(spark, sf_dir))
    return features.FeatureBuilder.fit(r).transform(blocked_records(r), (r.where("id % 2 = 0"), r.where("id % 2 = 1")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflict = graph.field_conflict(F.col("l_maker"), F.col("r_maker"), F.col("l_price"), F.col("r_price"))
    return graph.settled(blocked(spark, sf_dir).select("l_id", "r_id", F.round("rough_score", 9).alias("confidence"), conflict.alias("conflict")))


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_of(scored(spark, sf_dir))


def kept_of(s: DataFrame) -> DataFrame:
    return graph.settled(graph.retained(s, graph.mutual_best(s)))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = kept_pairs(spark, sf_dir)
    return graph.routed(graph.clusters(pairs, graph.components(pairs)))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score made of the document's length."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return y.join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), F.round(F.pmod(F.col("n_chars"), F.lit(1000)) / 1000.0, 3).alias("score"))


LABELED = "lab AS (SELECT l.doc_id, l.quality AS label, round((n_chars % 1000) / 1000.0, 3) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- scalar functions -------------------------------------------------------


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")).alias("plain"))


@query("SELECT p_partkey, CAST(round_even(CAST(p_retailprice AS DECIMAL(38,10)), 2) AS DOUBLE) AS price FROM part")
def normalize_price(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_price(F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"))).alias("price"))


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS number FROM events")
def parse_float(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.parse_float(F.col("props")).alias("number"))


@query("SELECT c_custkey, regexp_replace(c_name, '\\D', '', 'g') AS digits, length(regexp_replace(c_name, '\\D', '', 'g')) >= 7 AS phone_like FROM customer")
def digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.digits_only(F.col("c_name")).alias("digits"), N.is_phone_like(F.col("c_name")).alias("phone_like"))


@query("SELECT doc_id, n_chars BETWEEN 1400 AND 2200 AS is_year FROM documents")
def year(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.is_year_like(F.col("n_chars")).alias("is_year"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^0-9a-zA-Z]', '', 'g')) AS compact, list_aggregate(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: substr(w, 1, 1)), 'string_agg', '') AS initials FROM part")
def search_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.compact(F.col("p_name")).alias("compact"), T.initials(F.col("p_name")).alias("initials"))


@query(f"SELECT p_partkey, {norm('p_brand')} AS maker, {norm('p_name')} AS title, p_retailprice AS price, 0 AS price_missing FROM part")
def preprocess(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("list_price"))
    out = prepare.preprocess(prepare.rename_aliases(p))
    return out.select(F.col("id").cast("long").alias("p_partkey"), F.col("manufacturer_norm").alias("maker"), F.col("title_norm").alias("title"), F.col("price_norm").alias("price"), "price_missing")


def _pairwise(name: str, sql: str, column: Callable[[], Column]) -> None:
    def run(spark, sf_dir):
        return adjacent(spark, sf_dir).select("l_id", "r_id", r6(column().cast("double")).alias("value"))

    run.__name__ = name
    query(f"{ADJACENT} SELECT l_id, r_id, round(CAST({sql} AS DOUBLE), 6) AS value FROM pr")(run)


def stop_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_filter({toks(x)}, lambda t: length(t) > 1 AND NOT list_contains([{words}], t))"


def num_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'))"


c = F.col
_common = "len(list_intersect({0}, {1}))"
_pairwise("token_jaccard", jac("lk", "rk"), lambda: T.jaccard(c("l_tokens"), c("r_tokens")))
_pairwise("token_containment", ratio("lk", "rk", f"CAST({_common.format('lk', 'rk')} AS DOUBLE) / least(len(lk), len(rk))"), lambda: T.containment(c("l_tokens"), c("r_tokens")))
_pairwise("important_tokens", jac(stop_sql("lt"), stop_sql("rt")), lambda: T.jaccard(T.important_tokens(c("l_norm")), T.important_tokens(c("r_norm"))))
_pairwise("number_tokens", jac(num_sql("lt"), num_sql("rt")), lambda: T.jaccard(T.number_tokens(c("l_norm")), T.number_tokens(c("r_norm"))))
_pairwise("exact_set", ratio("lk", "rk", "CASE WHEN len(list_intersect(lk, rk)) = len(lk) AND len(lk) = len(rk) THEN 1.0 ELSE 0.0 END"), lambda: T.exact_set(c("l_tokens"), c("r_tokens")))
_pairwise("length_ratio", "CASE WHEN length(lt) = 0 AND length(rt) = 0 THEN 1.0 WHEN length(lt) = 0 OR length(rt) = 0 THEN 0.0 ELSE CAST(least(length(lt), length(rt)) AS DOUBLE) / greatest(length(lt), length(rt)) END", lambda: T.length_ratio(c("l_norm"), c("r_norm")))
_pairwise("price_similarity", "greatest(0.0, 1 - abs(lp - rp) / greatest(lp, rp, 1.0))", lambda: N.price_similarity(c("l_price"), c("r_price")))
_pairwise("price_log_delta", "abs(ln(1 + lp) - ln(1 + rp))", lambda: N.price_log_delta(c("l_price"), c("r_price")))
_pairwise("manufacturer_similarity", f"CASE WHEN lm = '' OR rm = '' THEN 0.5 WHEN lm = rm THEN 1.0 ELSE {jac(toks('lm'), toks('rm'))} END", lambda: T.manufacturer_similarity(c("l_maker"), c("r_maker")))
_pairwise("same_first_token", "CASE WHEN lt <> '' AND string_split(lt, ' ')[1] = string_split(rt, ' ')[1] THEN 1 ELSE 0 END", lambda: T.same_first_token(c("l_norm"), c("r_norm")))


# ---- profiles and statistics ------------------------------------------------


@query(
    "WITH x AS (SELECT 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) "
    "SELECT name, count(*) AS n, count(DISTINCT v) AS distinct_values, round(avg(length(v)), 6) AS avg_length FROM x GROUP BY name"
)
def column_profile(spark, sf_dir):
    out = profile.column_profile(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return out.select("name", F.col("filled").alias("n"), F.col("distinct").alias("distinct_values"), r6(F.col("avg_length")).alias("avg_length"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= (SELECT greatest(1, CAST(floor(0.1 * count(*)) AS BIGINT)) FROM events)")
def dominant_category(spark, sf_dir):
    found = profile.dominant(table(spark, sf_dir, "events").select(F.col("event_type").alias("v")))
    return found.select(F.col("v").alias("event_type"), "n")


@query("SELECT quality AS label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE), 6) AS share FROM labels GROUP BY quality")
def split_stats(spark, sf_dir):
    y = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    total = y.agg(F.sum("n").alias("all"))
    return y.crossJoin(F.broadcast(total)).select("label", "n", r6(F.col("n") / F.col("all")).alias("share"))  # one row


@query(f"WITH {RECORDS}, t AS (SELECT id, unnest(k) AS token FROM b) SELECT token, count(*) AS n FROM t GROUP BY token")
def postings(spark, sf_dir):
    return blocking.postings(sides(spark, sf_dir)[1])


@query(f"WITH {RECORDS}, t AS (SELECT id, unnest(k) AS term FROM rec), n AS (SELECT count(*) AS c FROM rec) SELECT term, count(*) AS df, round(ln(1 + ((SELECT c FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term")
def bm25_idf(spark, sf_dir):
    return features.bm25_statistics(features._words(records(spark, sf_dir))).select("term", "df", r6(F.col("idf")).alias("idf"))


WORD_TERMS = """wl AS (SELECT id, list_filter(string_split(t, ' '), lambda w: length(w) >= 2) AS w FROM rec),
terms AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wl)"""
CHAR_TERMS = """cw AS (SELECT id, unnest(list_filter(string_split(t, ' '), lambda w: w <> '')) AS w FROM rec),
pad AS (SELECT id, ' ' || w || ' ' AS w FROM cw),
terms AS (SELECT id, unnest(list_concat(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(w, i, 3)), list_transform(range(1, greatest(length(w) - 2, 1)), lambda i: substr(w, i, 4)), list_transform(range(1, greatest(length(w) - 3, 1)), lambda i: substr(w, i, 5)))) AS term FROM pad)"""
TFIDF = """tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM rec)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT id, tf.term, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
nrm AS (SELECT id, sqrt(sum(w * w)) AS n FROM raw GROUP BY id),
vec AS (SELECT raw.id, term, w / n AS w FROM raw JOIN nrm ON raw.id = nrm.id)"""


def _cosine(terms: str) -> str:
    return f"""{ADJACENT}, {terms}, {TFIDF}, dots AS (SELECT l_id, r_id, sum(x.w * y.w) AS d FROM pr JOIN vec x ON x.id = l_id JOIN vec y ON y.id = r_id AND x.term = y.term GROUP BY l_id, r_id)
SELECT pr.l_id, pr.r_id, round(coalesce(d, 0.0), 6) AS value FROM pr LEFT JOIN dots ON pr.l_id = dots.l_id AND pr.r_id = dots.r_id"""


def _cosines(spark, sf_dir, terms) -> DataFrame:
    r = records(spark, sf_dir)
    counts = features.term_counts(r, terms(F.col("title_norm")))
    vec = features.tfidf_vectors(counts, features.tfidf_idf(counts, r.count()))
    return features.sparse_dot(adjacent(spark, sf_dir), vec, vec, "v").select("l_id", "r_id", r6(F.col("v")).alias("value"))


@query(_cosine(WORD_TERMS))
def word_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir, T.word_ngrams)


@query(_cosine(CHAR_TERMS))
def char_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir, T.char_ngrams)


@query(f"WITH {RECORDS}, {WORD_TERMS}, {TFIDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_fit(spark, sf_dir):
    r = records(spark, sf_dir)
    return features.tfidf_idf(features.term_counts(r, T.word_ngrams(F.col("title_norm"))), r.count()).select("term", "df", r6(F.col("idf")).alias("idf"))


@query(
    f"""{ADJACENT}, wd AS (SELECT id, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM rec),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM wd), ex AS (SELECT id, len(w) AS ln, unnest(w) AS term FROM wd),
tf AS (SELECT id, ln, term, count(*) AS tf FROM ex GROUP BY id, ln, term),
idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
sc AS (SELECT id, tf.term, tf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / (SELECT al FROM st))) AS s FROM tf JOIN idf ON tf.term = idf.term),
slf AS (SELECT id, sum(tf * s) AS v FROM sc GROUP BY id),
bo AS (SELECT l_id, r_id, sum(x.tf * y.s) + sum(y.tf * x.s) AS v FROM pr JOIN sc x ON x.id = l_id JOIN sc y ON y.id = r_id AND x.term = y.term GROUP BY l_id, r_id)
SELECT pr.l_id, pr.r_id, round(greatest(0.0, least(1.0, coalesce(bo.v, 0.0) / (2 * greatest(coalesce(p.v, 0.0), coalesce(q.v, 0.0), 1e-9)))), 6) AS value
FROM pr LEFT JOIN bo ON pr.l_id = bo.l_id AND pr.r_id = bo.r_id LEFT JOIN slf p ON p.id = pr.l_id LEFT JOIN slf q ON q.id = pr.r_id"""
)
def bm25_similarity(spark, sf_dir):
    w = features._words(records(spark, sf_dir))
    out = features.bm25_similarity(adjacent(spark, sf_dir), w, features.bm25_statistics(w))
    return out.select("l_id", "r_id", r6(F.col("title_bm25_similarity")).alias("value"))


# ---- blocking, ranks, clusters ----------------------------------------------


@query(f"{MARGINS} SELECT l_id, r_id, round(c, 6) AS confidence FROM mg WHERE l_rank = 1 AND r_rank = 1 AND l_margin >= 0.01 AND r_margin >= 0.01 AND c >= 0.2 AND c < 1.0")
def mutual_best_wide(spark, sf_dir):
    """The clear best of both ends with bounds that the documents' titles reach, whatever their makers and prices."""
    s = scored(spark, sf_dir).withColumn("conflict", F.lit(False))
    return graph.mutual_best(s, low=0.2, high=1.0, margin=0.01).select("l_id", "r_id", r6(F.col("confidence")).alias("confidence"))


@query(f"{BLOCKED} SELECT l_id, r_id, round(s, 6) AS rough_score, rk AS rank FROM top")
def block_schema(spark, sf_dir):
    return blocked(spark, sf_dir).select("l_id", "r_id", r6(F.col("rough_score")).alias("rough_score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {RECORDS}, lt AS (SELECT id, unnest(k) AS x FROM a), rt AS (SELECT id, unnest(k) AS x FROM b),
cand AS (SELECT lt.id AS l_id, rt.id AS r_id FROM lt JOIN rt ON lt.x = rt.x UNION SELECT a.id, b.id FROM a JOIN b ON a.m = b.m AND a.m <> '' UNION SELECT a.id, b.id FROM a JOIN b ON a.t = '' AND b.t = ''),
s AS (SELECT l_id, r_id, {jac("a.k", "b.k")} AS j, a.m <> '' AND a.m = b.m AS same FROM cand JOIN a ON a.id = l_id JOIN b ON b.id = r_id)
SELECT l_id, r_id, round(j, 6) AS rough_score FROM s WHERE same OR j >= 0.18"""
)
def block_canonical(spark, sf_dir):
    return blocking.canonical_pairs(*sides(spark, sf_dir)).select("l_id", "r_id", r6(F.col("rough_score")).alias("rough_score"))


@query(f"{BLOCKED}, tr AS (SELECT a.id AS l_id, b.id AS r_id FROM a JOIN b ON a.t = b.t AND a.t <> ''), f AS (SELECT tr.*, top.l_id AS hit FROM tr LEFT JOIN top ON tr.l_id = top.l_id AND tr.r_id = top.r_id) SELECT count(hit) AS found, count(*) AS total, round(count(hit) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS recall FROM f")
def candidate_recall(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    truth = left.where("title_norm <> ''").join(right.select(F.col("id").alias("r_id"), "title_norm"), "title_norm").select(F.col("id").alias("l_id"), "r_id")
    return evaluation.candidate_recall(blocked(spark, sf_dir), truth)


@query("WITH v AS (SELECT doc_id, n_chars AS x FROM documents) SELECT doc_id, round((rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER (), 6) AS rank_pct FROM v")
def rank_pct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    return scoring.rank_pct(d, "x").select("doc_id", r6(F.col("rank_pct")).alias("rank_pct"))


@query(f"{MARGINS} SELECT l_id, r_id, round(l_margin, 6) AS l_margin, round(r_margin, 6) AS r_margin FROM mg WHERE l_rank = 1")
def best_margin(spark, sf_dir):
    return graph.with_margins(scored(spark, sf_dir)).where("l_rank = 1").select("l_id", "r_id", r6(F.col("l_margin")).alias("l_margin"), r6(F.col("r_margin")).alias("r_margin"))


@query(f"{MUTUAL} SELECT l_id, r_id, round(c, 6) AS confidence FROM mb")
def mutual_best(spark, sf_dir):
    return graph.mutual_best(scored(spark, sf_dir)).select("l_id", "r_id", r6(F.col("confidence")).alias("confidence"))


@query(f"{MARGINS} SELECT l_id, r_id FROM mg WHERE l_rank = 1 AND r_rank = 1 AND c >= 0.5")
def mutual_top(spark, sf_dir):
    return graph.mutual_top(scored(spark, sf_dir), 0.5).select("l_id", "r_id")


@query(f"{COMPONENTS} SELECT substr(node, 1, 1) AS side, substr(node, 3) AS id, component FROM comp")
def components(spark, sf_dir):
    return graph.components(kept_pairs(spark, sf_dir))


@query(f"{CLUSTERS} SELECT component, nl, nr, pair_count, round(max_confidence, 6) AS max_confidence, round(score_margin, 6) AS score_margin, conflict, competition FROM cl2")
def cluster_agg(spark, sf_dir):
    return routes(spark, sf_dir).select(
        "component", F.size("l_ids").cast("long").alias("nl"), F.size("r_ids").cast("long").alias("nr"), "pair_count", r6(F.col("max_confidence")).alias("max_confidence"),
        r6(F.col("score_margin")).alias("score_margin"), F.col("has_field_conflict").alias("conflict"), F.col("has_competition").alias("competition"),
    )


@query(f"{CLUSTERS} SELECT route, count(*) AS n, sum(pair_count) AS pairs FROM routes GROUP BY route")
def routing(spark, sf_dir):
    return routes(spark, sf_dir).groupBy(F.col("routing_decision").alias("route")).agg(F.count("*").alias("n"), F.sum("pair_count").alias("pairs"))


@query(f"{CLUSTERS} SELECT component, row_number() OVER (ORDER BY max_confidence DESC, component) AS seq FROM routes")
def cluster_number(spark, sf_dir):
    return graph.numbered(routes(spark, sf_dir)).select("component", F.col("cluster_seq").cast("long").alias("seq"))


@query(f"{SCORED} SELECT count(*) AS n, round(max(c), 6) AS best FROM sc WHERE c < 0.59")
def low_bucket(spark, sf_dir):
    return scored(spark, sf_dir).where("confidence < 0.59").agg(F.count("*").alias("n"), r6(F.max("confidence")).alias("best"))


@query(f"{SCORED} SELECT a.id FROM a WHERE a.id NOT IN (SELECT l_id FROM sc WHERE c >= 0.59)")
def unmatched_anti(spark, sf_dir):
    matched = scored(spark, sf_dir).where("confidence >= 0.59").select(F.col("l_id").alias("id"))
    return golden.unmatched(sides(spark, sf_dir)[0], matched).select("id")


@query(f"WITH {LABELED}, o AS (SELECT score, row_number() OVER (ORDER BY score, doc_id) - 1 AS i, count(*) OVER () AS n FROM lab) SELECT q, round(score, 6) AS score FROM o, (VALUES (0.1), (0.5), (0.9)) v(q) WHERE i = CAST(floor((n - 1) * q) AS BIGINT)")
def score_quantiles(spark, sf_dir):
    return evaluation.score_quantiles(labeled(spark, sf_dir), "score", [0.1, 0.5, 0.9]).select("q", r6(F.col("score")).alias("score"))


# ---- golden records ---------------------------------------------------------


def entities(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("manufacturer"), F.concat_ws(" ", F.lit("Segment"), "c_mktsegment", F.pmod("c_custkey", F.lit(97)).cast("string")).alias("canonical_title"), F.col("c_acctbal").alias("price"), F.lit("backend_active").alias("status"), (F.pmod("c_custkey", F.lit(10)) / 10.0).alias("confidence"))


def aliases(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    title = F.concat_ws(" ", F.lit("Order group"), F.floor(F.col("o_orderkey") / 2).cast("string"))
    return o.select(F.col("o_custkey").alias("entity_id"), title.alias("alias_title"), F.lower(title).alias("normalized_title"), F.lit("table1").alias("source_table"), F.col("o_orderkey").cast("string").alias("source_id"))


ENT = "ent AS (SELECT c_custkey AS entity_id, c_mktsegment AS manufacturer, 'Segment ' || c_mktsegment || ' ' || (c_custkey % 97) AS title, c_acctbal AS price, (c_custkey % 10) / 10.0 AS confidence FROM customer)"
ALI = "ali AS (SELECT o_custkey AS entity_id, 'Order group ' || (o_orderkey // 2) AS alias_title, CAST(o_orderkey AS VARCHAR) AS source_id FROM orders)"


@query(f"WITH {ENT}, k AS (SELECT lower(trim(title)) AS t, min(entity_id) AS keep FROM ent GROUP BY 1 HAVING count(*) > 1) SELECT entity_id, keep FROM ent JOIN k ON lower(trim(title)) = t WHERE entity_id <> keep")
def dup_canonical(spark, sf_dir):
    return golden.duplicate_titles(entities(spark, sf_dir))


@query(
    f"""WITH {ENT}, {ALI}, o AS (SELECT DISTINCT lower(alias_title) AS t, e.entity_id, lower(manufacturer) AS m, price FROM ali JOIN ent e ON ali.entity_id = e.entity_id)
SELECT t AS normalized_title, min(entity_id) AS keep, count(*) AS members FROM o GROUP BY t
HAVING count(*) > 1 AND count(DISTINCT m) <= 1 AND coalesce(CASE WHEN max(price) > 0 THEN (max(price) - min(price)) / max(price) END <= 0.5, true)"""
)
def dup_alias(spark, sf_dir):
    return golden.safe_alias_groups(entities(spark, sf_dir), aliases(spark, sf_dir)).select("normalized_title", "keep", F.size("members").cast("long").alias("members"))


@query(
    f"""WITH {ENT}, k AS (SELECT lower(trim(title)) AS t, min(entity_id) AS keep FROM ent GROUP BY 1)
SELECT keep AS entity_id, min(title) AS canonical_title, first(manufacturer ORDER BY entity_id) AS manufacturer, first(price ORDER BY entity_id) AS price, round(max(confidence), 6) AS confidence FROM ent JOIN k ON lower(trim(title)) = t GROUP BY keep"""
)
def merge_entities(spark, sf_dir):
    e, a = entities(spark, sf_dir), aliases(spark, sf_dir)
    merged, _, _ = golden.merge_entities(e, a, a.select("entity_id", "source_table", "source_id"), golden.duplicate_titles(e))
    return merged.select("entity_id", "canonical_title", "manufacturer", "price", r6(F.col("confidence")).alias("confidence"))


@query(f"WITH {ENT}, {ALI}, g AS (SELECT entity_id, string_agg(DISTINCT alias_title, ' | ' ORDER BY alias_title) AS aliases FROM ali GROUP BY entity_id) SELECT ent.entity_id, title, coalesce(aliases, '') AS aliases FROM ent LEFT JOIN g ON ent.entity_id = g.entity_id")
def golden_csv(spark, sf_dir):
    return golden.golden_csv(golden.golden_from_entities(entities(spark, sf_dir)), aliases(spark, sf_dir)).select("entity_id", "title", "aliases")


@query(f"WITH {ENT}, {ALI}, g AS (SELECT entity_id, count(DISTINCT alias_title) AS n, count(*) AS l FROM ali GROUP BY entity_id) SELECT ent.entity_id, title, coalesce(n, 0) AS n_aliases, coalesce(l, 0) AS n_links FROM ent LEFT JOIN g ON ent.entity_id = g.entity_id")
def golden_read(spark, sf_dir):
    a = aliases(spark, sf_dir)
    out = golden.golden_read(golden.golden_from_entities(entities(spark, sf_dir)), a, a)
    return out.select("entity_id", "title", F.size("aliases").cast("long").alias("n_aliases"), F.size("links").cast("long").alias("n_links"))


@query(f"WITH {ENT} SELECT entity_id, title FROM ent ORDER BY entity_id DESC LIMIT 20 OFFSET 10")
def page_read(spark, sf_dir):
    return golden.page(entities(spark, sf_dir).select("entity_id", F.col("canonical_title").alias("title")), "entity_id", limit=20, offset=10, ascending=False)


@query(f"WITH {ENT} SELECT entity_id, title, manufacturer, price, 'entity_snapshot' AS source FROM ent")
def rebuild_golden(spark, sf_dir):
    return golden.golden_from_entities(entities(spark, sf_dir)).select("entity_id", "title", "manufacturer", "price", "source")


@query(f"WITH {ENT} SELECT entity_id, title, CASE WHEN entity_id % 3 = 0 THEN 0.0 ELSE price END AS price FROM ent")
def upsert_golden(spark, sf_dir):
    g = golden.golden_from_entities(entities(spark, sf_dir)).select("entity_id", "title", "price")
    new = g.where("entity_id % 3 = 0").withColumn("price", F.lit(0.0))
    return golden.upsert(g, new, ["entity_id"])


@query("SELECT o_orderkey AS source_id, o_custkey AS entity_id FROM orders")
def link_if_missing(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("entity_id"))
    return golden.insert_missing(links.where("source_id % 2 = 0"), links, ["source_id"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def repair_links(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.lit("table1").alias("source_table"), F.col("l_orderkey").alias("source_id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"))
    return golden.unlinked(rows, held, "table1").select(F.col("source_id").alias("o_orderkey"))


@query(f"{ADJACENT} SELECT l_id, r_id, CASE WHEN length(rt) > length(lt) THEN r_id ELSE l_id END AS chosen FROM pr")
def pair_title(spark, sf_dir):
    p = adjacent(spark, sf_dir)
    title = golden.pair_title(F.col("l_title"), F.col("r_title"))
    return p.select("l_id", "r_id", F.when(title.eqNullSafe(F.col("l_title")) & ~(F.length("r_norm") > F.length("l_norm")), F.col("l_id")).otherwise(F.col("r_id")).alias("chosen"))


@query(f"{ADJACENT} SELECT l_id, r_id, CASE WHEN length(rt) > length(lt) AND lt <> rt THEN 'table2' ELSE 'table1' END AS side FROM pr")
def selected_side(spark, sf_dir):
    p = adjacent(spark, sf_dir)
    side = golden.selected_side(golden.pair_title(F.col("l_title"), F.col("r_title")), F.col("l_title"), F.col("r_title"))
    return p.select("l_id", "r_id", side.alias("side"))


@query("SELECT o_custkey AS entity_id, first('Order ' || o_orderkey ORDER BY length('Order ' || o_orderkey) DESC, o_orderkey) AS title FROM orders GROUP BY o_custkey")
def canonical_title(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderkey").alias("pos"))
    return golden.canonical_titles(o)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'Right' END AS value FROM supplier")
def golden_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.pmod("s_suppkey", F.lit(3))
    side = F.when(k == 0, "table1").when(k == 2, "table2")
    value = golden.surviving(side, F.lit(""), F.when(k == 0, F.col("s_name")), F.when(k == 2, F.lit("Right")))
    return s.select("s_suppkey", value.alias("value"))


@query(f"WITH {ENT}, {ALI} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ent) AS golden_records, 0 AS duplicate_source_links, (SELECT count(*) FROM (SELECT lower(alias_title) FROM ali GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)) AS duplicate_aliases, (SELECT count(*) FROM (SELECT lower(title) FROM ent GROUP BY 1 HAVING count(*) > 1)) AS duplicate_titles, (SELECT count(*) FROM ali) AS links_a, true AS valid")
def entity_quality(spark, sf_dir):
    e, a = entities(spark, sf_dir), aliases(spark, sf_dir)
    d = e.select(F.lit("same_entity").alias("decision"))
    out = golden.entity_quality(e, golden.golden_from_entities(e), a, a, d)
    return out.select("entities", "golden_records", "duplicate_source_links", "duplicate_aliases", "duplicate_titles", "links_a", "valid")


@query(
    """WITH f AS (SELECT p_partkey AS entity_id, lower(regexp_replace(p_name, '[^0-9a-zA-Z]', '', 'g')) AS c,
  list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), 'string_agg', '') AS i FROM part),
s AS (SELECT entity_id, CASE WHEN c = '' THEN NULL WHEN c = 'redwidget' THEN 1.0 WHEN starts_with(c, 'redwidget') THEN 0.94 WHEN contains(c, 'redwidget') THEN 0.86
  WHEN starts_with(i, 'redwidget') THEN 0.78 WHEN contains(i, 'redwidget') THEN 0.70
  WHEN contains(c, 'r') AND contains(c, 'e') AND contains(c, 'd') AND contains(c, 'w') AND contains(c, 'i') AND contains(c, 'g') AND contains(c, 't') THEN 0.48 END AS score FROM f)
SELECT entity_id, CAST(score AS DOUBLE) AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, entity_id LIMIT 25"""
)
def search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("title"), F.lit(1.0).alias("confidence"))
    return golden.search(p, "Red Widget", ["title"], limit=25).select("entity_id", "score")


_LOW = "lower(regexp_replace({0}, '[^0-9a-zA-Z]', '', 'g'))"
_INI = "list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), 'string_agg', '')"


@query(
    f"""WITH f AS (SELECT p_partkey AS entity_id, p_retailprice AS conf, {_LOW.format("p_name")} AS c, {_INI} AS i FROM part),
qs AS (SELECT p_partkey AS query_id, {_LOW.format("CASE p_partkey % 300 WHEN 0 THEN p_name WHEN 100 THEN split_part(p_name, ' ', -1) ELSE substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) END")} AS q FROM part WHERE p_partkey % 100 = 0),
s AS (SELECT query_id, entity_id, conf, CASE WHEN c = '' OR q = '' THEN NULL WHEN c = q THEN 1.0 WHEN starts_with(c, q) THEN 0.94 WHEN contains(c, q) THEN 0.86 WHEN starts_with(i, q) THEN 0.78 WHEN contains(i, q) THEN 0.70
  WHEN len(list_filter(string_split(q, ''), lambda x: NOT contains(c, x))) = 0 THEN 0.48 END AS score FROM f, qs),
r AS (SELECT query_id, entity_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conf DESC, entity_id) AS rank FROM s WHERE score IS NOT NULL)
SELECT * FROM r WHERE rank <= 20"""
)
def search_index(spark, sf_dir):
    """Every part whose key is divisible by 100 asks for its name, a word of it or two initials among all parts; the 20 best of each."""
    p = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 300 == 0, name).when(k % 300 == 100, F.split_part(name, F.lit(" "), F.lit(-1))).otherwise(F.concat(F.substring(name, 1, 1), F.substring(F.split_part(name, F.lit(" "), F.lit(2)), 1, 1)))
    index = indexed.build(p.select(k.alias("entity_id"), F.col("p_retailprice").alias("confidence"), name.alias("title")), ["title"])
    found = indexed.search_all(index, p.where(k % 100 == 0).select(k.alias("query_id"), text.alias("query")), limit=20, places=(200,))
    return found.select("query_id", "entity_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT n_name AS status, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def dashboard(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("status")).agg(F.count("*").alias("n"))


# ---- decisions --------------------------------------------------------------


@query("WITH e AS (SELECT conv_id AS cluster_id, turn AS member FROM conversations), g AS (SELECT * FROM e WHERE (cluster_id + member) % 7 <> 0 UNION ALL SELECT cluster_id, 99 FROM e WHERE member = 0 AND cluster_id % 11 = 0), x AS (SELECT coalesce(e.cluster_id, g.cluster_id) AS cluster_id, e.member AS w, g.member AS h FROM e FULL JOIN g ON e.cluster_id = g.cluster_id AND e.member = g.member) SELECT cluster_id, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected, count(*) FILTER (h IS NULL) = 0 AND count(*) FILTER (w IS NULL) = 0 AS valid FROM x GROUP BY cluster_id")
def llm_validate(spark, sf_dir):
    e = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("turn").cast("long").alias("member"))
    extra = e.where("member = 0 and cluster_id % 11 = 0").select("cluster_id", F.lit(99).cast("long").alias("member"))
    return adjudicate.validate_members(e, e.where("(cluster_id + member) % 7 <> 0").union(extra)).select("cluster_id", "missing", "unexpected", "valid")


@query("WITH b AS (SELECT DISTINCT conv_id AS cluster_id FROM conversations), c AS (SELECT cluster_id FROM b WHERE cluster_id % 37 <> 36) SELECT cluster_id FROM b WHERE cluster_id < (SELECT coalesce(min(cluster_id), (SELECT max(cluster_id) + 1 FROM b)) FROM b WHERE cluster_id NOT IN (SELECT cluster_id FROM c))")
def llm_prefix(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster_id")).distinct().withColumn("seq", F.col("cluster_id"))
    return adjudicate.covered_prefix(b, b.where("cluster_id % 37 <> 36")).select("cluster_id")


@query("SELECT DISTINCT conv_id AS cluster_id FROM conversations WHERE conv_id >= 10 AND conv_id < 40")
def candidate_batch(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster_id"), (F.col("conv_id") + 1).alias("cluster_seq")).distinct()
    return adjudicate.cluster_batch(c, offset=10, limit=30).select("cluster_id")


@query("SELECT CAST(event_id AS VARCHAR) AS cluster_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("cluster_id"), json_value(F.col("props"), "k").cast("long").alias("k"))


@query("SELECT CAST(event_id AS VARCHAR) AS cluster_id, event_type AS canonical_title, 'table1:' || user_id AS member FROM events")
def parse_llm(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entity = F.array(F.struct(F.col("event_type").alias("canonical_title"), F.array(F.concat(F.lit("table1:"), F.col("user_id"))).alias("members"), F.lit(0.9).alias("confidence")))
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_id").cast("string").alias("cluster_id"), entity.alias("entities"))).alias("clusters")))
    answer = F.concat(F.lit("<think>{not json}</think>\n```json\n"), body, F.lit("\n```"))
    return adjudicate.parsed_results(e.select(answer.alias("answer"))).select("cluster_id", "canonical_title", "member")


@query(f"WITH {RECORDS}, f AS (SELECT id % 20 AS cluster_id, CASE WHEN length(t) >= 6 AND t NOT IN ('software', 'quickbooks r', 'deposit slips') THEN t ELSE '#' || id END AS k FROM rec) SELECT cluster_id, count(*) AS groups, count(*) FILTER (n > 1) AS merged FROM (SELECT cluster_id, k, count(*) AS n FROM f GROUP BY cluster_id, k) GROUP BY cluster_id")
def fallback_groups(spark, sf_dir):
    r = records(spark, sf_dir).select(F.pmod("id", F.lit(20)).alias("cluster_id"), F.col("id").cast("string").alias("node_id"), "title")
    return adjudicate.fallback_groups(r).groupBy("cluster_id").agg(F.count("*").alias("groups"), F.count_if("merged").alias("merged"))


# ---- evaluation -------------------------------------------------------------


@query(f"WITH {LABELED}, x AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM lab) SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM x")
def prf(spark, sf_dir):
    return evaluation.prf(labeled(spark, sf_dir), "score", 0.5)


@query(f"WITH {LABELED} SELECT round((SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) FROM lab p, lab q WHERE p.label = 1 AND q.label = 0), 6) AS roc_auc")
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(labeled(spark, sf_dir), "score")


@query(f"WITH {LABELED}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM lab GROUP BY score), u AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(CAST(sum(CAST(tp AS DOUBLE) / CAST(al AS DOUBLE) * CAST(p AS DOUBLE)) / CAST(sum(p) AS DOUBLE) AS DOUBLE), 6) AS average_precision FROM u")
def avg_precision(spark, sf_dir):
    return evaluation.average_precision(labeled(spark, sf_dir), "score")


_GRID = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"WITH {LABELED}, g(threshold) AS (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in _GRID)}) SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM lab, g GROUP BY threshold")
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(labeled(spark, sf_dir), "score", _GRID).select("threshold", "tp", "fp", "fn")


@query("WITH p AS (SELECT c_nationkey AS e, 'c' || c_custkey AS r FROM customer), t AS (SELECT c_nationkey AS e, 'c' || c_custkey AS r FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey % 2 = 0), x AS (SELECT string_agg(r, '|' ORDER BY r) AS k FROM p GROUP BY e HAVING count(*) > 1), y AS (SELECT string_agg(r, '|' ORDER BY r) AS k FROM t GROUP BY e HAVING count(*) > 1) SELECT (SELECT count(*) FROM x WHERE k IN (SELECT k FROM y)) AS exact, (SELECT count(*) FROM x) AS predicted, (SELECT count(*) FROM y) AS truth")
def cluster_exact(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("ref"), "c_custkey")
    t = p.where("entity_id % 2 = 0 or c_custkey % 2 = 0")
    return evaluation.cluster_exact(p, t).select("exact", "predicted", "truth")


@query(f"{MARGINS}, t AS (SELECT l_id, r_id FROM sc WHERE c >= 0.8), p AS (SELECT l_id, r_id FROM mg WHERE l_rank = 1 AND r_rank = 1) SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM t)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t)) AS fp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p)) AS fn")
def pair_setops(spark, sf_dir):
    s = scored(spark, sf_dir)
    return evaluation.pair_counts(graph.mutual_top(s, 0.0), s.where("confidence >= 0.8"))


@query("WITH e AS (SELECT c_nationkey AS id, count(*) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS id, count(*) AS b FROM supplier GROUP BY 1), x AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM e FULL JOIN s ON e.id = s.id) SELECT CASE WHEN a = 1 AND b = 1 THEN 'merged_1x1' WHEN a > 0 AND b > 0 THEN 'merged_multi' WHEN a > 0 THEN 'only_a' ELSE 'only_b' END AS shape, count(*) AS n FROM x GROUP BY 1")
def entity_shapes(spark, sf_dir):
    of = lambda name, key, t: table(spark, sf_dir, name).select(F.col(key).alias("entity_id"), F.lit(t).alias("source_table"))
    return evaluation.shapes(of("customer", "c_nationkey", "table1").unionByName(of("supplier", "s_nationkey", "table2")))


@query("SELECT 'amazon:' || p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'other:' || s_suppkey, s_name FROM supplier")
def mixed_union(spark, sf_dir):
    one = lambda name, k, t: table(spark, sf_dir, name).select(F.col(k).alias("id"), F.col(t).alias("title"))
    return cards.mixed([("amazon", one("part", "p_partkey", "p_name")), ("other", one("supplier", "s_suppkey", "s_name"))], ["id"], ["id", "title"])


# ---- models and streams -----------------------------------------------------


@query(None)
def train_gbt(spark, sf_dir):
    """Pairs with the thirteen features and the probability of a boosted model of all its rounds."""
    label = (F.col("l_norm") == F.col("r_norm")).cast("double").alias("label")
    data = graph.settled(with_features(spark, sf_dir).select("l_id", "r_id", *features.FEATURES, label))
    return scoring.probability(scoring.train_gbt(data), data, "gbt_score").select("l_id", "r_id", "gbt_score")


def _own_names(sql: str, prefix: str) -> str:
    """A fragment whose tables have names of their own."""
    return re.sub(r"\b(cw|pad|wl|terms|tf|idf|raw|nrm|vec)\b", rf"{prefix}\1", sql)


def _dots(prefix: str) -> str:
    return f"{prefix}dots AS (SELECT l_id, r_id, sum(x.w * y.w) AS d FROM top JOIN {prefix}vec x ON x.id = l_id JOIN {prefix}vec y ON y.id = r_id AND x.term = y.term GROUP BY l_id, r_id)"


@query(
    f"""{BLOCKED}, {_own_names(CHAR_TERMS + ", " + TFIDF, "ch_")}, {_own_names(WORD_TERMS + ", " + TFIDF, "wo_")}, {_dots("ch_")}, {_dots("wo_")},
bw AS (SELECT id, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM rec), bst AS (SELECT count(*) AS n, avg(len(w)) AS al FROM bw), bex AS (SELECT id, len(w) AS ln, unnest(w) AS term FROM bw),
btf AS (SELECT id, ln, term, count(*) AS n FROM bex GROUP BY id, ln, term), bidf AS (SELECT term, ln(1 + ((SELECT n FROM bst) - count(*) + 0.5) / (count(*) + 0.5)) AS v FROM btf GROUP BY term),
bsc AS (SELECT id, btf.term, n, v * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * ln / (SELECT al FROM bst))) AS s FROM btf JOIN bidf ON btf.term = bidf.term), bslf AS (SELECT id, sum(n * s) AS v FROM bsc GROUP BY id),
bbo AS (SELECT l_id, r_id, sum(x.n * y.s) + sum(y.n * x.s) AS v FROM top JOIN bsc x ON x.id = l_id JOIN bsc y ON y.id = r_id AND x.term = y.term GROUP BY l_id, r_id),
lx AS (SELECT top.l_id, top.r_id, round((coalesce(ch_dots.d, 0) + coalesce(wo_dots.d, 0) + CAST({jac("a.k", "b.k")} AS DOUBLE) + CAST({jac(stop_sql("a.t"), stop_sql("b.t"))} AS DOUBLE) + CAST({jac(num_sql("a.t"), num_sql("b.t"))} AS DOUBLE)
  + greatest(0.0, least(1.0, coalesce(bbo.v, 0.0) / (2 * greatest(coalesce(p.v, 0.0), coalesce(q.v, 0.0), 1e-9))))) / 6, 9) AS s
  FROM top JOIN a ON a.id = top.l_id JOIN b ON b.id = top.r_id LEFT JOIN ch_dots ON ch_dots.l_id = top.l_id AND ch_dots.r_id = top.r_id LEFT JOIN wo_dots ON wo_dots.l_id = top.l_id AND wo_dots.r_id = top.r_id
  LEFT JOIN bbo ON bbo.l_id = top.l_id AND bbo.r_id = top.r_id LEFT JOIN bslf p ON p.id = top.l_id LEFT JOIN bslf q ON q.id = top.r_id)
SELECT l_id, r_id, round(0.45 * (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / count(*) OVER () + 0.55 * s, 6) AS confidence FROM lx"""
)
def fuse_scores(spark, sf_dir):
    """Confidence of pairs without models: the lexical score stands for both."""
    built = with_features(spark, sf_dir).select("l_id", "r_id", *features.LEXICAL)
    empty = F.lit(None).cast("double")
    return scoring.fused_scores(built.withColumns({"gbt_score": empty, "mlp_score": empty})).select("l_id", "r_id", r6(F.col("confidence")).alias("confidence"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def incremental_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = arrivals(e.withColumn("ts", F.col("ts").cast("timestamp")), time="ts", by="event_type")
    return out.select(F.col("window.start").alias("day"), "event_type", "n")


@query(
    """WITH h AS (SELECT doc_id, quality, toxic, md5('42:' || doc_id) AS h, count(*) OVER (PARTITION BY quality) AS n FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS r FROM h)
SELECT doc_id, quality, toxic FROM r WHERE r <= CAST(round_even(n * CASE quality WHEN 0 THEN 0.5 WHEN 1 THEN 0.2 ELSE 0.0 END, 0) AS BIGINT)"""
)
def stratified(spark, sf_dir):
    return cards.stratified(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "quality", {0: 0.5, 1: 0.2}, "doc_id")


_THRESHOLDS = f"(SELECT unnest({list(evaluation.THRESHOLDS)}) AS threshold)"


@query(
    f"""{MARGINS}, truth AS (SELECT a.id AS l_id, b.id AS r_id FROM a JOIN b ON a.t = b.t AND a.t <> ''),
g AS (SELECT mg.*, truth.l_id IS NOT NULL AS y FROM mg LEFT JOIN truth ON mg.l_id = truth.l_id AND mg.r_id = truth.r_id),
cells AS (SELECT rule, threshold, margin FROM {_THRESHOLDS}, (VALUES ('all_above', CAST(NULL AS DOUBLE)), ('mutual_top_1to1', NULL), ('mutual_top_margin_1to1', 0.0), ('mutual_top_margin_1to1', 0.04), ('mutual_top_margin_1to1', 0.1)) v(rule, margin)),
c AS (SELECT rule, threshold, margin, count(*) FILTER (WHERE l_id IS NOT NULL AND y) AS tp, count(l_id) AS predicted FROM cells LEFT JOIN g ON c >= threshold
  AND (rule = 'all_above' OR l_rank = 1 AND r_rank = 1 AND (rule = 'mutual_top_1to1' OR c < 0.94 AND NOT x AND least(l_margin, r_margin) >= margin)) GROUP BY rule, threshold, margin),
f AS (SELECT *, predicted - tp AS fp, (SELECT count(*) FROM truth) - tp AS fn FROM c),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM f)
SELECT rule, threshold, margin, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, predicted FROM pr"""
)
def rule_sweep(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    same = left.select(F.col("id").alias("l_id"), "title_norm").join(right.select(F.col("id").alias("r_id"), "title_norm"), "title_norm").where("title_norm <> ''")
    return evaluation.rule_sweep(scored(spark, sf_dir), same, margins=[0.0, 0.04, 0.1])
