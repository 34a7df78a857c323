"""Further named queries: the schema regime, commits and lineage, decisions, evaluation, cards and preparation.

Each has the SQL that gives the same rows.  The frames and fragments of
``catalog`` serve here as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions import jsontext as J
from goldweave.functions import numeric as N
from goldweave.functions import text as T
from goldweave.operators import adjudicate, blocking, cards, commit, evaluation, features, golden, graph, prepare, review, scoring
from goldweave.plans import profile as schema
from goldweave.plans.catalog import (
    ADJACENT, ALI, QUERIES, SQL, COMPONENTS, ENT, LABELED, RECORDS, SCORED, adjacent, aliases, entities, jac, kept_of, labeled, neighbours, norm, query, r6, records, routes, scored, sides, stop_sql, table, toks,
)
from goldweave.sources import tables as sources
from goldweave.sources.store import scratch

# ---- schema regime --------------------------------------------------------------

W = (0.529412, 0.352941, 0.117647)
PLAN = schema.SchemaProfile(
    True, "fixed", 1.0, "product", "product", "product", {"title": "title", "manufacturer": "manufacturer", "price": "price"},
    {"title": "primary_name", "manufacturer": "creator_or_brand", "price": "numeric_auxiliary"}, dict(zip(("title", "manufacturer", "price"), W, strict=True)), ["title", "manufacturer"], ["title", "manufacturer", "price"],
)
#: Records with the tokens of all three columns.
PARTS = f"""{RECORDS.split(", a AS")[0].replace("docs AS", "docs AS", 1)},
pt AS (SELECT rec.*, {toks("m")} AS km, [CAST(CAST(p AS BIGINT) AS VARCHAR)] AS kp, list_distinct(list_concat(k, {toks("m")})) AS kb FROM rec),
a AS (SELECT * FROM pt WHERE id % 2 = 0), b AS (SELECT * FROM pt WHERE id % 2 = 1)"""


def _rough(l: str, r: str) -> str:  # noqa: E741
    total, used = [], []
    for c, w in zip(("k", "km", "kp"), W, strict=True):
        x, y = f"{l}.{c}", f"{r}.{c}"
        total.append(f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 0.0 ELSE {w} * {jac(x, y)} END")
        used.append(f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 0.0 ELSE {w} END")
    return f"CAST(({' + '.join(total)}) / ({' + '.join(used)}) AS DOUBLE)"


def _numeric(l: str, r: str) -> str:  # noqa: E741
    return f"greatest(0.0, 1 - abs({l} - {r}) / greatest(abs({l}), abs({r}), 1.0))"


def _similar(l: str, r: str) -> str:  # noqa: E741
    return f"CAST(({W[0]} * {jac(f'{l}.k', f'{r}.k')} + {W[1]} * {jac(f'{l}.km', f'{r}.km')} + {W[2]} * {_numeric(f'{l}.p', f'{r}.p')}) / {sum(W)} AS DOUBLE)"


def profiled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("source").alias("manufacturer"), F.col("n_chars").alias("price"))
    return tuple(schema.apply_profile(d.where(F.col("id") % 2 == k), PLAN, s) for k, s in ((0, "a"), (1, "b")))


def profiled_neighbours(spark, sf_dir) -> DataFrame:
    left, right = profiled(spark, sf_dir)
    return left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).join(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), F.col("l_id").cast("long") + 1 == F.col("r_id").cast("long"))


def profiled_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    return blocking.block_schema(left, right, cap=blocking.posting_cap(right.count()), weights=schema.part_weights(PLAN), blocking=schema.blocking_parts(PLAN))


TOP = f"""WITH {PARTS}, cap AS (SELECT greatest(25, CAST(floor(count(*) * 0.08) AS BIGINT)) AS c FROM b),
lt AS (SELECT id, unnest(kb) AS x FROM a), rt AS (SELECT id, unnest(kb) AS x FROM b), rare AS (SELECT x FROM rt GROUP BY x HAVING count(*) <= (SELECT c FROM cap)),
cand AS (SELECT DISTINCT lt.id AS l_id, rt.id AS r_id FROM lt JOIN rt ON lt.x = rt.x WHERE lt.x IN (SELECT x FROM rare)),
rough AS (SELECT l_id, r_id, {_rough("a", "b")} AS s, {_similar("a", "b")} AS c FROM cand JOIN a ON l_id = a.id JOIN b ON r_id = b.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY s DESC, CAST(r_id AS VARCHAR)) AS rk FROM rough WHERE s >= 0.18) WHERE rk <= 40)"""


@query(f"WITH {PARTS} SELECT id, t AS title, m AS maker, round(p, 2) AS price, len(kb) AS tokens, len(k) AS title_tokens FROM pt")
def apply_profile(spark, sf_dir):
    left, right = profiled(spark, sf_dir)
    return left.unionByName(right).select(
        F.col("id").cast("long").alias("id"), F.col("title_norm").alias("title"), F.col("manufacturer_norm").alias("maker"), F.col("price_norm").alias("price"), F.size("tokens").cast("long").alias("tokens"),
        F.size(F.get("parts", 0)).cast("long").alias("title_tokens"),
    )


@query(f"WITH {PARTS} SELECT a.id AS l_id, b.id AS r_id, round({_rough('a', 'b')}, 6) AS rough_score FROM a JOIN b ON a.id + 1 = b.id")
def rough_score(spark, sf_dir):
    p = profiled_neighbours(spark, sf_dir)
    return p.select(F.col("l_id").cast("long").alias("l_id"), F.col("r_id").cast("long").alias("r_id"), r6(blocking.rough_score(F.col("l_parts"), F.col("r_parts"), schema.part_weights(PLAN))).alias("rough_score"))


@query(
    f"""WITH {PARTS} SELECT a.id AS l_id, b.id AS r_id, round(CAST({jac("a.k", "b.k")} AS DOUBLE), 6) AS title, round(CAST({jac("a.km", "b.km")} AS DOUBLE), 6) AS maker,
round(CAST({_numeric("a.p", "b.p")} AS DOUBLE), 6) AS price, round({_similar("a", "b")}, 6) AS weighted FROM a JOIN b ON a.id + 1 = b.id"""
)
def schema_similarity(spark, sf_dir):
    p = schema.schema_features(profiled_neighbours(spark, sf_dir), PLAN)
    names = {"schema_title_similarity": "title", "schema_manufacturer_similarity": "maker", "schema_price_similarity": "price", "schema_weighted_similarity": "weighted"}
    return p.select(F.col("l_id").cast("long").alias("l_id"), F.col("r_id").cast("long").alias("r_id"), *[r6(F.col(k).cast("double")).alias(v) for k, v in names.items()])


@query(f"{TOP} SELECT l_id, r_id, round(s, 6) AS rough_score, rk AS rank FROM top")
def topk_left(spark, sf_dir):
    p = profiled_pairs(*map(graph.settled, profiled(spark, sf_dir)))
    return p.select(F.col("l_id").cast("long").alias("l_id"), F.col("r_id").cast("long").alias("r_id"), r6(F.col("rough_score")).alias("rough_score"), F.col("rank").cast("long").alias("rank"))


@query(f"{TOP}, v AS (SELECT l_id, r_id, round(c, 9) AS c FROM top) SELECT l_id, r_id, round(c, 6) AS confidence, round((rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / count(*) OVER (), 6) AS rank_fusion FROM v")
def schema_scored(spark, sf_dir):
    left, right = map(graph.settled, profiled(spark, sf_dir))
    extra = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), *[F.col(f"m_{i}").alias(f"{p}_m_{i}") for i in range(3)])
    pairs = profiled_pairs(left, right).select("l_id", "r_id").join(extra(left, "l"), "l_id").join(extra(right, "r"), "r_id")
    s = graph.settled(schema.schema_features(pairs, PLAN).select("l_id", "r_id", F.round("schema_weighted_similarity", 9).alias("c")))
    return scoring.rank_pct(s, "c").select(F.col("l_id").cast("long").alias("l_id"), F.col("r_id").cast("long").alias("r_id"), r6(F.col("c")).alias("confidence"), r6(F.col("rank_pct")).alias("rank_fusion"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 WHEN s_suppkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS phone, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE CAST(greatest(0.0, 1 - 1.0 / greatest(s_suppkey + 1, 1.0)) AS DOUBLE) END AS number FROM supplier")
def column_similarity(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    missing = F.col("s_suppkey") % 5 == 0
    phone = F.when(missing, "none").otherwise(F.concat(F.lit("+1 "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")))
    other = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("(1) "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).otherwise(F.lit("555-0000000"))
    number = F.when(missing, "-").otherwise(F.col("s_suppkey").cast("string"))
    value = lambda l, r, role: schema.column_similarity(l, r, role).cast("double")
    return s.select("s_suppkey", value(phone, other, "phone").alias("phone"), value(number, (F.col("s_suppkey") + 1).cast("string"), "numeric_auxiliary").alias("number"))


# Fixed values of the sample: a name and what it becomes, by the part's key.
_MAKERS = [("MS", "microsoft"), ("Adobe Systems Incorporated", "adobe"), ("Sage Software, Inc", "sage software"), ("Broderbund Software", "broderbund"), ("CA", "computer associates"), ("Intuit", "intuit")]


@query(f"SELECT p_partkey, [{', '.join(repr(b) for _, b in _MAKERS)}][p_partkey % {len(_MAKERS)} + 1] AS maker FROM part")
def normalize_manufacturer(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.get(F.array(*[F.lit(a) for a, _ in _MAKERS]), (F.col("p_partkey") % len(_MAKERS)).cast("int"))
    return p.select("p_partkey", T.normalize_manufacturer(raw).alias("maker"))


@query("SELECT p_partkey, ['microsoft', 'computer associates', 'symantec', 'brand 7'][p_partkey % 4 + 1] AS brand FROM part")
def normalize_brand(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("Microsoft Corp.", "ca", "Symantec Corporation", "Brand#7")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_brand(raw).alias("brand"))


@query("SELECT p_partkey, ['fine café ©', 'at t', 'a b', 'ms office 2007', 'x 2 y'][p_partkey % 5 + 1] || ' ' || p_partkey AS norm FROM part")
def normalize_unicode(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("ﬁne caf&eacute; &copy;", "AT&amp;T", "a<br/>b", "ＭＳ Office　2007", "x² y".replace("x²", "x ²"))]), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_text(F.concat_ws(" ", raw, F.col("p_partkey").cast("string"))).alias("norm"))




@query(
    f"""{ADJACENT}, f AS (SELECT l_id, r_id, {jac("lk", "rk")} AS tj, {jac(stop_sql("lt"), stop_sql("rt"))} AS ij,
  CASE WHEN lm = '' OR rm = '' THEN 0.5 WHEN lm = rm THEN 1.0 ELSE {jac(toks("lm"), toks("rm"))} END AS ms, greatest(0.0, 1 - abs(lp - rp) / greatest(lp, rp, 1.0)) AS ps, abs(ln(1 + lp) - ln(1 + rp)) AS pd FROM pr)
SELECT l_id, r_id, round(CAST(tj AS DOUBLE), 6) AS title_token_jaccard, round(CAST(ij AS DOUBLE), 6) AS important_token_jaccard, round(CAST(ms AS DOUBLE), 6) AS manufacturer_similarity, round(CAST(ps AS DOUBLE), 6) AS price_similarity, round(pd, 6) AS price_log_delta FROM f"""
)
def pair_features(spark, sf_dir):
    p = features.token_features(adjacent(spark, sf_dir))
    return p.select("l_id", "r_id", *[r6(F.col(c).cast("double")).alias(c) for c in ("title_token_jaccard", "important_token_jaccard", "manufacturer_similarity", "price_similarity", "price_log_delta")])


@query(
    """SELECT s_suppkey AS "case", CASE WHEN s_suppkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS expected, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 ELSE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 END AS passed,
s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS rejected, CASE WHEN s_nationkey > 0 THEN round(CAST(s_suppkey % 11 AS DOUBLE) / s_nationkey, 6) ELSE 0.0 END AS coverage_a, CASE WHEN s_nationkey > 0 THEN round(CAST(s_suppkey % 13 AS DOUBLE) / s_nationkey, 6) ELSE 0.0 END AS coverage_b FROM supplier"""
)
def case_summary(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k, rows = F.col("s_suppkey"), F.col("s_nationkey")
    cases = s.select(
        k.alias("case"), (k % 2 == 0).alias("positive"), F.when(k % 3 == 0, "dataset_type_mismatch").when(k % 4 == 0, "same_entity_table").alias("relation_type"),
        F.when(k % 5 == 0, "reupload_required").otherwise("completed").alias("ingest_status"), (k % 7 != 0).alias("quality_valid"), (k % 11).alias("links_a"), (k % 13).alias("links_b"),
        rows.alias("rows_a"), rows.alias("rows_b"),
    )
    return evaluation.case_summary(cases)


# ---- sources --------------------------------------------------------------------


@query(f"WITH {ENT} SELECT 'entity:' || entity_id AS id, title, manufacturer, price FROM ent")
def master_scan(spark, sf_dir):
    e = entities(spark, sf_dir)
    return sources.master_scan(e, golden.golden_from_entities(e)).select("id", "title", "manufacturer", F.col("price").cast("double").alias("price"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, max(ts) AS updated_at FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, CAST(user_id AS VARCHAR) DESC LIMIT 1) GROUP BY 1")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("props").alias("payload"), F.col("ts").alias("updated_at"))
    return sources.latest_run(e).select("run_id", "updated_at")


@query("SELECT c_custkey AS entity_id, c_name AS title, 'table1:' || c_custkey AS ref FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, 'table2:' || (c_custkey + 1) FROM customer WHERE c_custkey % 2 = 0")
def ref_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = lambda keep, v: F.when(keep, v.cast("string")).otherwise(" ")
    rows = c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("title"), own(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("source_A_id"), own(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1).alias("source_B_id"))
    return sources.reference_pairs(rows)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_guard(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return e.select("event_id", J.json_value(raw, "k").cast("long").alias("k"))


# ---- commits and lineage ----------------------------------------------------------


def candidates(spark, sf_dir) -> DataFrame:
    """A candidate for each customer: two members, and every third is an entity of the master on its left side."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = k.cast("string")
    member = lambda t, i, title: F.struct(F.lit(t).alias("source_table"), i.alias("source_id"), title.alias("title"), F.col("c_mktsegment").alias("manufacturer"), F.col("c_acctbal").cast("string").alias("price"))
    members = F.array(member("table1", text, F.col("c_name")), member("table2", text, F.concat("c_name", F.lit(" plus"))))
    linked = F.struct(F.concat(F.lit("entity:"), (F.col("k") % 10).cast("string")).alias("id"), F.lit("Master").alias("title"), F.lit(None).alias("manufacturer"), F.lit(None).alias("price"), F.lit(None).alias("attributes"))
    rows = c.select(text.alias("cand_id"), F.concat("c_name", F.lit(" plus")).alias("title"), F.lit("llm").alias("source"), F.lit(0.8).alias("confidence"), F.lit("test").alias("reason"), members.alias("members"), F.lit(None).cast(commit.SCORES).alias("scores"), k.alias("k"))
    made = commit.candidates_from_members(rows.drop("k")).join(rows.select("cand_id", "k"), "cand_id")
    return made.withColumn("table1", F.when(F.col("k") % 3 == 0, linked.cast(commit.SIDE)).otherwise(F.col("table1"))).drop("k")


def candidate_links(spark, sf_dir) -> DataFrame:
    """Every fourth customer's second reference belongs to an entity already."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0")
    return c.select(F.lit("table2").alias("source_table"), F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("entity_id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS cand_id, 'table1' AS source_table, CAST(c_custkey AS VARCHAR) AS source_id FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'table2', CAST(c_custkey AS VARCHAR) FROM customer")
def source_refs(spark, sf_dir):
    return commit.source_refs(candidates(spark, sf_dir)).select("cand_id", "source_table", "source_id")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS cand_id, 'table1' AS source_table, CAST(c_custkey AS VARCHAR) AS source_id, c_name AS alias_title FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'table2', CAST(c_custkey AS VARCHAR), c_name || ' plus' FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'entity', CAST(c_custkey % 10 AS VARCHAR), 'Master' FROM customer WHERE c_custkey % 3 = 0"""
)
def alias_refs(spark, sf_dir):
    return commit.alias_refs(candidates(spark, sf_dir)).select("cand_id", "source_table", "source_id", "alias_title")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS cand_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS VARCHAR) ELSE 'e' || c_custkey END AS entity_id, c_custkey % 12 = 0 AS conflict
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0"""
)
def upsert_entity(spark, sf_dir):
    return commit.owners(candidates(spark, sf_dir), candidate_links(spark, sf_dir)).select("cand_id", "entity_id", "conflict")


@query("SELECT CAST(c_custkey AS VARCHAR) AS cand_id, c_name || ' plus' AS title, c_mktsegment AS manufacturer, round_even(abs(c_acctbal)::DECIMAL(20,4), 2)::DOUBLE AS price, 'tableB' AS selected_source_table, 'llm_active' AS status, 'table2' AS side FROM customer")
def golden_payload(spark, sf_dir):
    p = commit.golden_payload(candidates(spark, sf_dir), [("name", "title"), ("manufacturer", "manufacturer"), ("price", "price")])
    return p.select("cand_id", "title", "manufacturer", "price", "selected_source_table", "status", J.json_value(F.col("payload"), "selected_side").alias("side"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS cand_id, c_name || ' plus' AS name, c_mktsegment AS maker, CAST(NULL AS VARCHAR) AS city FROM customer")
def master_record(spark, sf_dir):
    m = commit.master_record(commit.with_lineage(candidates(spark, sf_dir)), [("name", "title"), ("maker", "manufacturer"), ("city", "city")])
    return m.select("cand_id", "master_record.*")


def _committed(spark, sf_dir) -> dict[str, DataFrame]:
    from goldweave.plans.engine import SCHEMAS

    empty = {n: spark.createDataFrame([], SCHEMAS[n]) for n in ("entities", "golden", "links", "aliases", "decisions", "log")}
    return commit.commit(empty | {"links": candidate_links(spark, sf_dir).withColumns({"title": F.lit(None).cast("string"), "manufacturer": F.lit(None).cast("string"), "price": F.lit(None).cast("double")})}, candidates(spark, sf_dir), run_id="r")


@query(
    """SELECT (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) + (SELECT count(DISTINCT c_custkey % 10) FROM customer WHERE c_custkey % 3 = 0) AS entities, 2 * count(*) AS links,
(SELECT count(*) FROM customer WHERE c_custkey % 12 = 0) AS conflicts, count(*) AS decisions FROM customer"""
)
def commit_candidates(spark, sf_dir):
    done = _committed(spark, sf_dir)
    one = lambda df, n: df.agg(F.count("*").alias(n))
    conflicts = done["log"].where("operation = 'entity_link_conflict'")
    return one(done["entities"], "entities").crossJoin(one(done["links"], "links")).crossJoin(one(conflicts, "conflicts")).crossJoin(one(done["decisions"], "decisions"))  # single rows


#: The entities that the candidates become: new ones by the hash of their references, those of a link, and ten of the master.
_OWNED = """own AS (SELECT *, CAST(c_custkey AS VARCHAR) AS t, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS VARCHAR) WHEN c_custkey % 4 = 0 THEN 'e' || c_custkey
ELSE sha256('table1:' || c_custkey || '|table2:' || c_custkey) END AS entity_id FROM customer),
last AS (SELECT entity_id, arg_max(c_name, t) || ' plus' AS title, arg_max(c_mktsegment, t) AS maker, arg_max(round_even(abs(c_acctbal)::DECIMAL(20,4), 2)::DOUBLE, t) AS price FROM own GROUP BY entity_id)"""


@query(f"WITH {_OWNED} SELECT entity_id AS id, title AS name, maker, 'llm_active' AS status, 'tableB' AS selected_source_table FROM last")
def master_view(spark, sf_dir):
    done = _committed(spark, sf_dir)
    v = commit.master_view(done["golden"], done["entities"], [("name", "title"), ("maker", "manufacturer")])
    return v.select("id", "name", "maker", "status", "selected_source_table")


@query(f"WITH {_OWNED} SELECT entity_id, title AS canonical_title, maker AS manufacturer, price, 'llm_active' AS status, CAST(0.8 AS DOUBLE) AS confidence FROM last")
def commit_entities(spark, sf_dir):
    return _committed(spark, sf_dir)["entities"].select("entity_id", "canonical_title", "manufacturer", "price", "status", "confidence")


@query(
    f"""WITH {_OWNED}, lk AS (SELECT entity_id, 'table1' AS source_table FROM own UNION ALL SELECT CASE WHEN c_custkey % 4 = 0 THEN 'e' || c_custkey ELSE entity_id END, 'table2' FROM own),
per AS (SELECT last.entity_id, count(lk.entity_id) AS k FROM last LEFT JOIN lk ON last.entity_id = lk.entity_id GROUP BY last.entity_id)
SELECT 'selected_source_table' AS series, 'tableB' AS label, count(*) AS n FROM last UNION ALL SELECT 'status', 'llm_active', count(*) FROM last UNION ALL SELECT 'decision', 'same_entity', count(*) FROM own
UNION ALL SELECT 'source_table', source_table, count(*) FROM lk GROUP BY source_table UNION ALL SELECT 'links_of_entity', CAST(k AS VARCHAR), count(*) FROM per GROUP BY k"""
)
def chart_series(spark, sf_dir):
    done = _committed(spark, sf_dir)
    return golden.chart_series(done["entities"], done["decisions"], done["links"])


@query(
    f"""WITH {_OWNED} SELECT entity_id, 'table1' AS source_table, t AS source_id FROM own
UNION ALL SELECT CASE WHEN c_custkey % 4 = 0 THEN 'e' || c_custkey ELSE entity_id END, 'table2', t FROM own"""
)
def commit_links(spark, sf_dir):
    """All links after the commit: those of the second table that every fourth customer had before stay."""
    return _committed(spark, sf_dir)["links"].select("entity_id", "source_table", "source_id")


@query(
    """SELECT sha256('table1:' || s_suppkey || '|table2:' || (s_suppkey + 1000000)) AS id, s_name AS Beer_Name, 'Works ' || n_name || ' ' || s_suppkey AS Brew_Factory_Name, 'style ' || (s_suppkey % 7) AS Style,
CAST(s_suppkey % 12 AS VARCHAR) || ' %' AS ABV, 'backend_active' AS status, 'tableA' AS selected_source_table FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def engine_master(spark, sf_dir):
    """Two tables of the suppliers as beers through the whole engine: schema plan, blocking, scores, routes, commit, finalisation, and the view of the planned columns."""
    from goldweave.plans.engine import Engine

    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    beers = s.select(
        k.alias("id"), F.col("s_name").alias("Beer_Name"), F.concat_ws(" ", F.lit("Works"), "n_name", k.cast("string")).alias("Brew_Factory_Name"), F.concat(F.lit("style "), (k % 7).cast("string")).alias("Style"),
        F.concat((k % 12).cast("string"), F.lit(" %")).alias("ABV"),
    )
    engine = Engine(spark, scratch(spark, "engine_master"))
    run = engine.resolve(beers, beers.withColumn("id", F.col("id") + 1_000_000))
    engine.finalize(run.run_id)
    # The whole view: a page would hold 10,000 rows at most.
    return commit.master_view(engine.table("golden"), engine.table("entities"), engine.specs()).drop("confidence")


@query(
    """SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'incoming' WHEN c_custkey % 4 = 1 THEN 'tableA' WHEN c_custkey % 4 = 2 THEN 'tableB' ELSE 'unknown' END AS label,
CASE WHEN c_custkey % 5 = 0 THEN 'uncertain' WHEN c_custkey % 2 = 0 THEN 'llm_active' ELSE 'backend_active' END AS status FROM customer"""
)
def backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    e = c.select(k.alias("entity_id"), F.col("c_name").alias("canonical_title"), F.when(k % 4 == 0, "incoming").otherwise("wrong").alias("selected_source_table"), F.when(k % 5 == 0, "uncertain").alias("status"))
    g = c.select(k.alias("entity_id"), F.when(k % 2 == 0, "llm").otherwise("auto").alias("source"))
    a = c.where("c_custkey % 4 = 1").select(k.alias("entity_id"), F.upper("c_name").alias("alias_title"), F.lit("table1").alias("source_table"), F.lit("x").alias("source_id"))
    links = c.where("c_custkey % 4 = 2").select(k.alias("entity_id"), F.lit("other").alias("title"), F.lit("table2").alias("source_table"), k.cast("string").alias("source_id"))
    fixed, _ = commit.backfill(e, g, a, links)
    return fixed.select("entity_id", F.col("selected_source_table").alias("label"), "status")


@query(f"{COMPONENTS} SELECT substr(node, 1, 1) AS side, CAST(substr(node, 3) AS BIGINT) AS id FROM comp")
def matched_ids(spark, sf_dir):
    r = routes(spark, sf_dir).where("routing_decision <> 'different_entity'")
    one = lambda s: r.select(F.lit(s).alias("side"), F.explode(f"{s}_ids").alias("id"))
    return one("l").unionByName(one("r"))


@query(f"{COMPONENTS}, used AS (SELECT l_id FROM rt2 UNION SELECT l_id FROM mb), used_r AS (SELECT r_id FROM rt2 UNION SELECT r_id FROM mb) SELECT count(*) AS n, round(max(c), 6) AS best FROM sc WHERE c < 0.59 AND l_id NOT IN (SELECT l_id FROM used) AND r_id NOT IN (SELECT r_id FROM used_r)")
def low_pairs(spark, sf_dir):
    s = scored(spark, sf_dir)
    used = kept_of(s).select("l_id", "r_id").union(graph.mutual_best(s).select("l_id", "r_id"))
    return graph.low_pairs(s, used).agg(F.count("*").alias("n"), r6(F.max("confidence")).alias("best"))


@query(f"{SCORED} SELECT l_id, r_id, round(c, 6) AS confidence FROM sc ORDER BY c DESC, l_id, r_id LIMIT 10")
def first_pairs(spark, sf_dir):
    """The ten best pairs in a total order, a report."""
    return scored(spark, sf_dir).orderBy(F.desc("confidence"), "l_id", "r_id").limit(10).select("l_id", "r_id", r6(F.col("confidence")).alias("confidence"))


# ---- decisions --------------------------------------------------------------------

_LLM = """e AS (SELECT CAST(conv_id AS VARCHAR) AS cluster_id, 'table' || (1 + turn % 2) || ':' || turn AS node_id, 'table' || (1 + turn % 2) AS source_table, CAST(turn AS VARCHAR) AS source_id, role || ' ' || turn AS title, turn FROM conversations),
g AS (SELECT cluster_id, node_id, CASE WHEN turn < 2 THEN 0 ELSE 1 END AS entity_pos FROM e WHERE turn % 5 <> 4)"""


def _decisions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    source = F.concat(F.lit("table"), (1 + t % 2).cast("string"))
    e = c.select(
        F.col("conv_id").cast("string").alias("cluster_id"), F.concat(source, F.lit(":"), t.cast("string")).alias("node_id"), source.alias("source_table"), t.cast("string").alias("source_id"),
        F.concat("role", F.lit(" "), t.cast("string")).alias("title"), F.lit(None).cast("string").alias("manufacturer"), F.lit(None).cast("string").alias("price"), F.lit(0.7).alias("max_confidence"), t,
    )
    g = e.where("turn % 5 <> 4").select("cluster_id", F.when(t < 2, 0).otherwise(1).alias("entity_pos"), F.lit("chosen").alias("canonical_title"), F.lit(None).cast("double").alias("confidence"), F.lit("same").alias("decision"), F.lit("").alias("reason"), F.col("node_id").alias("member"))
    return e, g


@query(f"WITH {_LLM} SELECT e.cluster_id, CAST(entity_pos AS BIGINT) AS entity_pos, 'chosen' AS title, CAST(0.7 AS DOUBLE) AS confidence, count(*) AS members, true AS foreign_title FROM e JOIN g ON e.cluster_id = g.cluster_id AND e.node_id = g.node_id GROUP BY e.cluster_id, entity_pos")
def llm_join(spark, sf_dir):
    e, g = _decisions(spark, sf_dir)
    return adjudicate.joined_results(e, g).select("cluster_id", F.col("entity_pos").cast("long").alias("entity_pos"), "title", "confidence", F.size("members").cast("long").alias("members"), "foreign_title")


@query(f"WITH {_LLM} SELECT cluster_id, node_id AS member FROM e WHERE turn % 5 = 4")
def uncovered(spark, sf_dir):
    e, g = _decisions(spark, sf_dir)
    return adjudicate.uncovered_members(e.withColumnRenamed("node_id", "member"), g)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'longer ' || s_name ELSE s_name END AS chosen FROM supplier")
def local_choice(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    pairs = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("longer "), "s_name")).otherwise("x").alias("l_title"), F.col("s_name").alias("r_title"), F.lit(None).cast("double").alias("confidence"))
    return adjudicate.local_pairs(pairs).select("s_suppkey", F.col("chosen_title").alias("chosen"))


@query("SELECT conv_id AS cluster_id, max(turn) AS pos FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def latest_results(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("pos"))
    return adjudicate.latest_only(c, c.where("cluster_id % 2 = 0").select("cluster_id").distinct()).select("cluster_id", "pos")


@query(
    """WITH t AS (SELECT s_suppkey AS k, s_acctbal AS c, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS position FROM supplier)
SELECT position, CASE WHEN k % 5 = 0 OR position % 3 = 1 THEN 'right ' || k ELSE 'left ' || k END AS title, 'human' AS source FROM t WHERE position % 3 < 2"""
)
def review_apply(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pairs = s.select(F.col("s_acctbal").alias("confidence"), k.alias("l_id"), k.alias("r_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("left "), k.cast("string"))).alias("l_title"), F.concat(F.lit("right "), k.cast("string")).alias("r_title"))
    task = review.review_task(pairs, "t")
    choice = F.get(F.array(F.lit("table1"), F.lit("table2"), F.lit("skip")), (F.col("position") % 3).cast("int"))
    made = review.apply_choices(task, task.select("position", choice.alias("choice")))
    return made.select(F.expr("cast(substring(cand_id, 3) as long)").alias("position"), "title", "source")


@query("WITH t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS position FROM supplier) SELECT position, s_suppkey FROM t WHERE position >= 3 AND position < 6")
def review_page(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("confidence"), F.col("s_suppkey").alias("l_id"), F.col("s_suppkey").alias("r_id"))
    return review.review_page(review.review_task(s, "t"), 2, 3).select("position", F.col("l_id").alias("s_suppkey"))


# ---- evaluation ---------------------------------------------------------------------

_EVAL = """p AS (SELECT c_nationkey AS e, 'table' || (1 + c_custkey % 2) || ':' || c_custkey AS r FROM customer WHERE c_custkey % 11 <> 0),
t AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 100 + c_custkey END AS e, 'table' || (1 + c_custkey % 2) || ':' || c_custkey AS r FROM customer WHERE c_custkey % 13 <> 0),
pc AS (SELECT e, string_agg(r, '|' ORDER BY r) AS k FROM (SELECT DISTINCT e, r FROM p) GROUP BY e), tc AS (SELECT e, string_agg(r, '|' ORDER BY r) AS k FROM (SELECT DISTINCT e, r FROM t) GROUP BY e),
pp AS (SELECT DISTINCT a.r AS l, b.r AS r FROM p a JOIN p b ON a.e = b.e WHERE starts_with(a.r, 'table1:') AND starts_with(b.r, 'table2:')),
tp AS (SELECT DISTINCT a.r AS l, b.r AS r FROM t a JOIN t b ON a.e = b.e WHERE starts_with(a.r, 'table1:') AND starts_with(b.r, 'table2:'))"""


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ref = F.concat(F.lit("table"), (1 + k % 2).cast("string"), F.lit(":"), k.cast("string")).alias("ref")
    p = c.where(k % 11 != 0).select(n.cast("long").alias("entity_id"), ref)
    return p, c.where(k % 13 != 0).select(F.when(n % 2 == 0, n.cast("long")).otherwise(100 + k).alias("entity_id"), F.lit("Title").alias("title"), ref)


@query(f"WITH {_EVAL} SELECT e AS entity_id, k AS members FROM pc")
def eval_clusters(spark, sf_dir):
    return evaluation.clusters_of(_linked(spark, sf_dir)[0])


@query(f"WITH {_EVAL} SELECT substr(l, 8) AS l_id, substr(r, 8) AS r_id FROM pp")
def cross_pairs(spark, sf_dir):
    return evaluation.cross_pairs(_linked(spark, sf_dir)[0])


@query(
    f"""WITH {_EVAL}, x AS (SELECT (SELECT count(DISTINCT k) FROM tc) AS reference_clusters, (SELECT count(DISTINCT k) FROM pc) AS predicted_clusters, (SELECT count(*) FROM (SELECT k FROM pc INTERSECT SELECT k FROM tc)) AS exact_clusters,
  (SELECT count(*) FROM (SELECT r FROM p WHERE starts_with(r, 'table1') INTERSECT SELECT r FROM t)) AS a_covered, (SELECT count(*) FROM (SELECT r FROM t WHERE starts_with(r, 'table1') EXCEPT SELECT r FROM p)) AS a_missing,
  (SELECT count(*) FROM (SELECT * FROM pp INTERSECT SELECT * FROM tp)) AS tp, (SELECT count(*) FROM (SELECT * FROM pp EXCEPT SELECT * FROM tp)) AS fp, (SELECT count(*) FROM (SELECT * FROM tp EXCEPT SELECT * FROM pp)) AS fn)
SELECT *, CASE WHEN predicted_clusters > 0 THEN round(exact_clusters / CAST(predicted_clusters AS DOUBLE), 6) ELSE 0.0 END AS cluster_precision, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) ELSE 0.0 END AS precision,
  exact_clusters AS titles_compared, exact_clusters AS titles_equal FROM x"""
)
def eval_report(spark, sf_dir):
    p, t = _linked(spark, sf_dir)
    e = p.select("entity_id").distinct().withColumn("canonical_title", F.lit("  TITLE "))
    names = ["reference_clusters", "predicted_clusters", "exact_clusters", "a_covered", "a_missing", "tp", "fp", "fn", "cluster_precision", "precision", "titles_compared", "titles_equal"]
    return evaluation.eval_report(p, t, e).select(*names)


@query(f"WITH {_EVAL} SELECT 'missing_reference_cluster' AS side, k AS members FROM (SELECT k FROM tc EXCEPT SELECT k FROM pc) UNION ALL SELECT 'extra_predicted_cluster', k FROM (SELECT k FROM pc EXCEPT SELECT k FROM tc)")
def cluster_mismatches(spark, sf_dir):
    return evaluation.mismatches(*_linked(spark, sf_dir))


@query("SELECT o_orderkey AS pair, o_custkey AS l_id, l_suppkey AS r_id, c_name AS l_name, s_name AS r_name FROM (SELECT o_orderkey, o_custkey, o_orderkey % 200 AS l_suppkey FROM orders) JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
def eval_join(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), F.col("o_custkey").alias("l_id"), (F.col("o_orderkey") % 200).alias("r_id"))
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return evaluation.labeled_pairs(pairs, left, right).select("pair", "l_id", "r_id", "l_name", "r_name")


@query(f"WITH {LABELED} SELECT round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (score >= 0.5) AS predicted_positive FROM lab")
def accuracy(spark, sf_dir):
    return evaluation.accuracy(labeled(spark, sf_dir), "score", 0.5).select("accuracy", "predicted_positive")


_STEPS = [k / 20 for k in range(1, 20)]


@query(
    f"""WITH {LABELED}, w AS (SELECT i * 25 / 100.0 AS a, j * 25 / 100.0 AS b, (4 - i - j) * 25 / 100.0 AS c FROM range(5) x(i), range(5) y(j) WHERE i + j <= 4),
th(t) AS (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in _STEPS)}),
s AS (SELECT a, b, c, t, label, (CAST(0.0 AS DOUBLE) + CAST(a AS DOUBLE) * score + CAST(b AS DOUBLE) * (CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.25 END)::DOUBLE + CAST(c AS DOUBLE) * (1 - score)) >= t AS hit FROM lab, w, th),
m AS (SELECT a, b, c, t, 2.0 * count(*) FILTER (hit AND label = 1) / greatest(1, 2 * count(*) FILTER (hit AND label = 1) + count(*) FILTER (hit AND label <> 1) + count(*) FILTER (NOT hit AND label = 1)) AS f1 FROM s GROUP BY a, b, c, t)
SELECT round(CAST(max(f1) AS DOUBLE), 6) AS f1 FROM m"""
)
def tune_weights(spark, sf_dir):
    lab = labeled(spark, sf_dir).withColumns({"x": F.col("score"), "y": F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25), "z": 1 - F.col("score")})
    return evaluation.tune_weights(lab, ["x", "y", "z"], step=25, thresholds=_STEPS).select("f1")


# ---- cards and preparation ------------------------------------------------------------

_FIELDS = "f AS (SELECT 'p_name' AS field, nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), '') AS v FROM part UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part UNION ALL SELECT 'p_name', nullif(trim(s_name), '') FROM supplier UNION ALL SELECT 'bal', CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '$' || s_suppkey || '%' END FROM supplier)"


def _card_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "part").select(F.col("p_name").alias("table1.p_name"), F.col("p_retailprice").cast("string").alias("p_retailprice"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("right_p_name"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("$"), F.col("s_suppkey").cast("string"), F.lit("%"))).alias("bal"))
    return a, b


@query(f"WITH {_FIELDS} SELECT field, count(*) AS total_count, count(*) FILTER (v IS NULL) AS null_count, count(DISTINCT v) AS unique_count, CAST(max(length(v)) AS BIGINT) AS max_length, CASE WHEN field IN ('p_retailprice', 'bal') THEN 'numeric' ELSE 'text' END AS data_type, round(count(DISTINCT v) / CAST(count(v) AS DOUBLE), 6) AS unique_rate FROM f GROUP BY field")
def field_profile(spark, sf_dir):
    return cards.field_profile(*_card_tables(spark, sf_dir)).select("field", "total_count", "null_count", "unique_count", F.col("max_length").cast("long").alias("max_length"), "data_type", "unique_rate")


@query(f"WITH {_FIELDS} SELECT field, CASE WHEN field = 'p_name' THEN '{cards.METHODS['other']}' ELSE '{cards.METHODS['number']}' END AS method, 'product' AS entity_type, least(5, count(DISTINCT v)) AS examples FROM f GROUP BY field")
def dataset_cards(spark, sf_dir):
    found = cards.dataset_cards("walmart_parts", *_card_tables(spark, sf_dir))
    return found.select("field", F.col("recommended_match_method").alias("method"), "entity_type", F.size("example_values").cast("long").alias("examples"))


@query("SELECT 'all' AS split, count(*) AS total, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative FROM labels")
def split_statistics(spark, sf_dir):
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("string").alias("quality"))
    return cards.split_statistics("all", y).select("split", "total", "positive", "negative")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'a \"' || p_name || '\" b' ELSE '' END AS text, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) ELSE '' END AS price FROM part")
def clean_quotes(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" \"'"), "p_name", F.lit("'\" "))).when(k % 3 == 1, F.concat(F.lit('"a ""'), "p_name", F.lit('"" b"'))).otherwise(F.lit('"'*2))
    price = F.when(k % 2 == 0, F.concat(F.lit('"'), (k + 1).cast("string"), F.lit('.00"'))).otherwise(F.lit("-3"))
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_quotes(raw).alias("text"), N.clean_price(T.clean_quotes(price)).alias("price"))


@query(
    """WITH pr AS (SELECT c_custkey AS l, c_custkey AS r FROM customer WHERE c_custkey < 50 AND c_custkey % 2 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier)),
x AS (SELECT 0 AS part, l AS a, r AS b, c_name AS title FROM pr JOIN customer ON l = c_custkey UNION ALL SELECT 1, c_custkey, NULL, c_name FROM customer WHERE c_custkey NOT IN (SELECT l FROM pr)
  UNION ALL SELECT 2, NULL, s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT r FROM pr))
SELECT 'GT-' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END AS entity_id, title, coalesce(CAST(a AS VARCHAR), '') AS source_A_id, coalesce(CAST(b AS VARCHAR), '') AS source_B_id FROM (SELECT *, row_number() OVER (ORDER BY part, a NULLS FIRST, b NULLS FIRST) AS n FROM x)"""
)
def gt_master(spark, sf_dir):
    side = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).cast("string").alias("id"), F.col(n).alias("title"), F.lit("").alias("manufacturer"), F.lit("").alias("price"))
    a, b = side("customer", "c_custkey", "c_name"), side("supplier", "s_suppkey", "s_name")
    split = a.join(b.select("id"), "id", "left_semi").where("cast(id as long) < 50").select(F.when(F.col("id").cast("long") % 2 == 0, "1").otherwise("0").alias("label"), F.concat(F.lit('"'), "id", F.lit('"')).alias("left_id"), F.col("id").alias("right_id"))
    return cards.truth_master(a, b, cards.positive_pairs(split, split)).select("entity_id", "title", "source_A_id", "source_B_id")


@query("SELECT (SELECT count(*) FROM customer) AS a_rows, (SELECT count(*) FROM supplier) AS b_rows, (SELECT count(*) FROM orders) AS positive_pairs, (SELECT count(DISTINCT o_custkey) FROM orders) AS matched_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated_left")
def dataset_summary(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"))
    return cards.dataset_summary(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), pairs).select("a_rows", "b_rows", "positive_pairs", "matched_left", "repeated_left")


@query("SELECT 'x:' || p_partkey AS id, p_name AS title, '' AS manufacturer FROM part")
def mixed_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return cards.namespaced(p, "x", ["id"], ["id", "title", "manufacturer"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS _id, CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '0' END AS label, s_name AS l_title, 'r' || s_suppkey AS r_title FROM supplier")
def pairs_scan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, '"1"').otherwise("x").alias("label"), F.col("s_name").alias("left_title"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("right_title"))
    return sources.sided(cards.prepared_pairs(raw)).select("_id", "label", "l_title", "r_title")


@query("SELECT p_partkey, p_name AS title, p_brand AS manufacturer, p_retailprice AS price FROM part")
def rename_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Product Name"), F.col("p_brand").alias("VENDOR"), F.col("p_retailprice").alias("list_price"))
    return prepare.rename_aliases(p)


@query(None)
def train_mlp(spark, sf_dir):
    """Pairs with the probability of a network over the thirteen features, trained until it settles or has had all its rounds."""
    r = graph.settled(records(spark, sf_dir))  # texts are read once
    built = features.FeatureBuilder.fit(r).transform(neighbours(r))
    data = graph.settled(built.withColumn("label", (F.col("title_token_jaccard") > 0.15).cast("double")))
    return scoring.probability(scoring.train_mlp(data), data, "mlp_score").select("l_id", "r_id", "mlp_score")


@query(f"WITH {ENT}, {ALI} SELECT ent.entity_id, count(*) AS n FROM ent JOIN ali ON ent.entity_id = ali.entity_id WHERE {norm('alias_title')} <> '' GROUP BY ent.entity_id")
def alias_counts(spark, sf_dir):
    a = aliases(spark, sf_dir).where(T.normalize_text(F.col("alias_title")) != "")
    return entities(spark, sf_dir).join(a, "entity_id").groupBy("entity_id").agg(F.count("*").alias("n"))


