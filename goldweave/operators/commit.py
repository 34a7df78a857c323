"""From chosen candidates to master rows: owners, references, aliases, payloads, the master view and its lineage.

A candidate is one row: ``cand_id``, ``title``, ``source``, ``confidence``,
``reason``, an explicit ``entity_id`` or null, ``members``
(array<struct<source_table, source_id, title, manufacturer, price, attributes>>),
the two sides ``table1`` and ``table2`` (struct<id, title, manufacturer, price,
attributes>, or null), ``attributes`` (map of further columns) and ``scores``.
The attributes of a record map the columns of the schema plan to their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions.jsontext import json_value
from goldweave.functions.numeric import normalize_price
from goldweave.functions.text import normalize_text
from goldweave.operators.golden import insert_missing, present, selected_side, source_label, status_for, upsert

ATTRIBUTES = "map<string,string>"
SIDE = f"struct<id:string,title:string,manufacturer:string,price:string,attributes:{ATTRIBUTES}>"
MEMBER = f"struct<source_table:string,source_id:string,title:string,manufacturer:string,price:string,attributes:{ATTRIBUTES}>"
SCORES = "struct<gbt_score:double,mlp_score:double,lexical_score:double,rank_fusion_score:double,confidence:double>"
CANDIDATE = (
    f"cand_id string, title string, source string, confidence double, reason string, entity_id string, members array<{MEMBER}>, table1 {SIDE}, table2 {SIDE}, "
    f"attributes map<string,string>, scores {SCORES}"
)
# States of an entity, and labels of the table that its title came from.
STATUSES, LABELS = ["backend_active", "llm_active", "uncertain"], ["tableA", "tableB", "incoming", "unknown"]
UNTITLED = "untitled"
_ENTITY = "entity:"


def candidates_from_members(entities: DataFrame) -> DataFrame:
    """Candidates of decided clusters: ``members`` in order fill both sides with the first of each source table.

    ``entities`` has cand_id, title, source, confidence, reason, members and
    scores; members may lack attributes.
    """
    fields = entities.schema["members"].dataType.elementType.fieldNames()
    if "attributes" not in fields:
        whole = F.transform("members", lambda m: F.struct(*[m[f].alias(f) for f in fields], F.lit(None).cast(ATTRIBUTES).alias("attributes")))
        entities = entities.withColumn("members", whole)
    first = lambda t: F.get(F.filter("members", lambda m: m["source_table"] == t), 0)
    side = lambda m: F.when(m.isNotNull(), F.struct(m["source_id"].alias("id"), m["title"].alias("title"), m["manufacturer"].alias("manufacturer"), m["price"].alias("price"), m["attributes"].alias("attributes")))
    longest = F.array_max(F.transform("members", lambda m, i: F.struct(F.length(F.coalesce(m["title"], F.lit(""))).alias("n"), (-i).alias("i"), m["title"].alias("t"))))["t"]
    return entities.select(
        "cand_id", F.coalesce(present(F.col("title")), longest, F.lit(UNTITLED)).alias("title"), "source", F.coalesce("confidence", F.lit(0.9)).alias("confidence"), "reason",
        F.lit(None).cast("string").alias("entity_id"), F.col("members").cast(f"array<{MEMBER}>").alias("members"), side(first("table1")).cast(SIDE).alias("table1"),
        side(first("table2")).cast(SIDE).alias("table2"), F.lit(None).cast("map<string,string>").alias("attributes"), F.col("scores").cast(SCORES).alias("scores"),
    )


def _refs(members: Column) -> Column:
    """All references of a candidate in order: its members, then its sides, but not a side that is an entity."""
    named = F.filter(members, lambda m: present(m["source_table"]).isNotNull() & present(m["source_id"]).isNotNull())
    none = F.array().cast(f"array<{MEMBER}>")

    def side(name: str, counts: Column) -> Column:
        s = F.col(name)
        one = F.struct(F.lit(name).alias("source_table"), s["id"].alias("source_id"), s["title"].alias("title"), s["manufacturer"].alias("manufacturer"), s["price"].alias("price"), s["attributes"].alias("attributes"))
        return F.coalesce(F.when(present(s["id"]).isNotNull() & counts, F.array(one).cast(f"array<{MEMBER}>")), none)

    entity = F.startswith(F.col("table1.id"), F.lit(_ENTITY))
    return F.concat(F.coalesce(named.cast(f"array<{MEMBER}>"), none), side("table1", ~entity), side("table2", F.lit(True)))


def source_refs(candidates: DataFrame) -> DataFrame:
    """(cand_id, source_table, source_id, pos, title, manufacturer, price, attributes); a candidate without any reference is an incoming row of its own id."""
    refs = _refs(F.col("members"))
    alone = F.array(F.struct(F.lit("incoming").alias("source_table"), F.col("cand_id").alias("source_id"), "title", F.lit(None).alias("manufacturer"), F.lit(None).alias("price"), F.lit(None).alias("attributes")).cast(MEMBER))
    out = candidates.select("cand_id", F.posexplode(F.when(F.size(refs) > 0, refs).otherwise(alone)).alias("pos", "r")).select("cand_id", "pos", "r.*")
    first = [F.min_by(c, "pos").alias(c) for c in ("title", "manufacturer", "price", "attributes")]
    return out.groupBy("cand_id", "source_table", "source_id").agg(F.min("pos").alias("pos"), *first)


def alias_refs(candidates: DataFrame) -> DataFrame:
    """(cand_id, source_table, source_id, alias_title, normalized_title) of members and sides, else of the title itself."""
    alias = lambda t, i, x: F.struct(t.alias("source_table"), F.coalesce(i, F.lit("")).alias("source_id"), x.alias("alias_title"))
    own = F.transform("members", lambda m: alias(F.coalesce(m["source_table"], F.lit("")), m["source_id"], m["title"]))
    linked = F.startswith(F.coalesce(F.col("table1.id"), F.lit("")), F.lit(_ENTITY))
    one = alias(F.when(linked, "entity").otherwise("table1"), F.when(linked, F.expr(f"substring(table1.id, {len(_ENTITY) + 1})")).otherwise(F.col("table1.id")), F.col("table1.title"))
    two = alias(F.lit("table2"), F.col("table2.id"), F.col("table2.title"))
    none = F.array().cast("array<struct<source_table:string,source_id:string,alias_title:string>>")
    every = F.filter(F.concat(F.coalesce(own, none), F.array(one), F.array(two)), lambda a: present(a["alias_title"]).isNotNull())
    title = F.array(alias(F.lit("canonical"), F.lit(""), F.col("title")))
    out = candidates.select("cand_id", F.explode(F.when(F.size(every) > 0, every).otherwise(title)).alias("a")).select("cand_id", "a.*")
    return out.withColumn("normalized_title", normalize_text(F.col("alias_title"))).dropDuplicates(["cand_id", "source_table", "source_id", "normalized_title"])


def owners(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """(cand_id, entity_id, conflict, entity_ids): who owns a candidate already.

    In order count an ``entity:`` side, an explicit id, then the links of its
    references by their place; more than one distinct owner is a conflict.
    """
    side = candidates.where(F.startswith(F.coalesce(F.col("table1.id"), F.lit("")), F.lit(_ENTITY))).select("cand_id", F.lit(-2).alias("pos"), F.expr(f"substring(table1.id, {len(_ENTITY) + 1})").alias("entity_id"))
    told = candidates.where("entity_id is not null").select("cand_id", F.lit(-1).alias("pos"), F.col("entity_id").cast("string").alias("entity_id"))
    held = source_refs(candidates).join(links.select("source_table", "source_id", F.col("entity_id").cast("string").alias("entity_id")), ["source_table", "source_id"]).select("cand_id", "pos", "entity_id")
    found = side.unionByName(told).unionByName(held)
    out = found.groupBy("cand_id").agg(F.min_by("entity_id", F.struct("pos", "entity_id")).alias("entity_id"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return out.select("cand_id", "entity_id", (F.size("entity_ids") > 1).alias("conflict"), "entity_ids")


def with_lineage(candidates: DataFrame) -> DataFrame:
    """Candidates with the side whose title was selected, and the label of the table it came from.

    The label comes from the side, else from the member of that title, else
    from the first reference, else it is unknown.
    """
    side = selected_side(F.col("title"), F.col("table1.title"), F.col("table2.title"))
    out = candidates.withColumns({"selected_side": side, "__title": normalize_text(F.col("title"))})
    # Member titles are compared by their normal form, which needs a row each.
    each = out.select("cand_id", "__title", F.posexplode("members").alias("pos", "m")).where(normalize_text(F.col("m.title")) == F.col("__title")).where("__title <> ''")
    named = each.groupBy("cand_id").agg(F.min_by("m.source_table", "pos").alias("__member"))
    first = F.get(_refs(F.col("members")), 0)["source_table"]
    out = out.join(named, "cand_id", "left")
    label = F.coalesce(source_label(F.col("selected_side")), source_label(F.col("__member")), source_label(first), F.lit("unknown"))
    return out.withColumn("selected_source_table", label).drop("__title", "__member")


def _of_side(field: str) -> Column:
    """The selected side's value, else the attribute, else the first side's, else the second's, else the first member's that has one."""
    own = F.when(F.col("selected_side") == "table1", F.col(f"table1.{field}")).when(F.col("selected_side") == "table2", F.col(f"table2.{field}"))
    member = F.get(F.filter(F.transform("members", lambda m: present(m[field])), lambda v: v.isNotNull()), 0)
    return F.coalesce(present(own), present(F.element_at("attributes", F.lit(field))), present(F.col(f"table1.{field}")), present(F.col(f"table2.{field}")), member)


def master_value(source: str, output: str) -> Column:
    """A master column's value: by the selected side, the second, the first, the attributes, then the members.

    Of each record the attribute of that name counts before its own field.
    """
    known = source in ("title", "manufacturer", "price")
    of = lambda r: [present(F.element_at(r["attributes"], F.lit(source))), *([present(r[source])] if known else [])]
    own = [F.when(F.col("selected_side") == t, F.coalesce(*of(F.col(t)))) for t in ("table1", "table2")]
    tries = [*own, *of(F.col("table2")), *of(F.col("table1")), present(F.element_at("attributes", F.lit(source)))]
    tries.append(F.get(F.filter(F.transform("members", lambda m: F.coalesce(*of(m))), lambda v: v.isNotNull()), 0))
    value = F.coalesce(*tries, *([F.col("title")] if source in ("title", "name") else []))
    return normalize_price(value).cast("string") if output in ("price", "amount", "list_price") else value


def master_record(candidates: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """``candidates`` with lineage and ``master_record``, a struct of the columns (output, source); a missing first one is the title."""
    values = [master_value(source, output) for output, source in specs]
    first = F.coalesce(values[0], F.col("title"))
    return candidates.withColumn("master_record", F.struct(*[v.alias(o) for v, (o, _) in zip([first, *values[1:]], specs, strict=True)]))


def golden_payload(candidates: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """(cand_id, title, manufacturer, price, selected_source_table, status, payload, attributes): the payload as JSON, and what its master record holds besides title, maker and price as a map."""
    out = master_record(with_lineage(candidates), specs)
    out = out.withColumns({"manufacturer": _of_side("manufacturer"), "price": normalize_price(_of_side("price")), "status": status_for(F.col("source"))})
    payload = F.struct(
        "title", "manufacturer", "price", F.array(*[F.lit(o) for o, _ in specs]).alias("master_columns"), "master_record", "source", "status", "selected_side", "selected_source_table",
        "confidence", "reason", F.struct(F.col("table1.id").alias("table1"), F.col("table2.id").alias("table2")).alias("source_ids"), F.col("scores").alias("match_scores"),
        F.struct("members", "table1", "table2", "attributes").alias("candidate"),
    )
    entries = [F.struct(F.lit(o).alias("key"), F.col("master_record").getField(o).alias("value")) for o, source in specs if source not in ("title", "manufacturer", "price")]
    record = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.lit(None)
    return out.select(
        "cand_id", "title", "manufacturer", "price", "selected_source_table", "status", "source", "confidence", "reason", F.to_json(payload).alias("payload"), record.cast(ATTRIBUTES).alias("attributes"), "table1", "table2", "scores"
    )


def changes(links: DataFrame, candidates: DataFrame, *, specs: list[tuple[str, str]] | None = None, run_id: str = "") -> dict[str, DataFrame]:
    """What the candidates change: rows to upsert in entities and golden, to insert in links and aliases, to append to decisions and log.

    Each candidate goes to its owner, else to an entity whose id is made from
    its references; of several candidates of one entity the last by ``cand_id``
    gives its row.  ``links`` needs to hold only the candidates' references.
    """
    specs = specs or [("title", "title"), ("manufacturer", "manufacturer"), ("price", "price")]
    candidates = candidates.withColumn("title", F.coalesce(present(F.col("title")), present(F.col("table1.title")), present(F.col("table2.title")), F.lit(UNTITLED)))
    made = golden_payload(candidates, specs)
    refs = source_refs(candidates)
    name = F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source_table", "source_id"))), "|"), 256)
    fresh = refs.groupBy("cand_id").agg(name.alias("fresh"))
    held = owners(candidates, links)
    owned = fresh.join(held, "cand_id", "left").select("cand_id", F.coalesce("entity_id", "fresh").alias("entity_id"), "conflict", "entity_ids")
    rows = made.join(owned, "cand_id")
    last = rows.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "entity_id"]), "cand_id").alias("x")).select("entity_id", "x.*")
    entities = last.select("entity_id", F.col("title").alias("canonical_title"), "manufacturer", "price", "status", "selected_source_table", F.greatest("confidence", F.lit(0.0)).alias("confidence"), "attributes")
    golden = last.select("entity_id", "title", "manufacturer", "price", "selected_source_table", F.col("payload").alias("source_payload"), "source", "confidence")
    linked = refs.join(owned, "cand_id").select("entity_id", "source_table", "source_id", "title", "manufacturer", normalize_price(F.col("price")).alias("price"), "attributes")
    names = alias_refs(candidates).join(owned, "cand_id").select("entity_id", "alias_title", "normalized_title", "source_table", "source_id")
    decision = F.when(F.col("source").isin("llm", "human", "auto"), "same_entity").otherwise("uncertain")
    decisions = made.select(
        F.lit(run_id).alias("run_id"), F.col("cand_id").alias("cluster_id"), F.col("table1.id").alias("left_id"), F.col("table2.id").alias("right_id"), decision.alias("decision"),
        "confidence", "reason", F.to_json("scores").alias("model_scores"),
    )
    log = rows.select(F.lit("commit").alias("operation"), F.to_json(F.struct("title", "source", "confidence", "reason", "entity_id")).alias("payload"))
    clash = owned.where("conflict").select(F.lit("entity_link_conflict").alias("operation"), F.to_json(F.struct("cand_id", "entity_ids")).alias("payload"))
    return {"entities": entities, "golden": golden, "links": linked, "aliases": names, "decisions": decisions, "log": log.unionByName(clash)}


#: Keys by which rows of the master tables are told apart; what has none is appended.
UPSERT_KEYS = {"entities": ["entity_id"], "golden": ["entity_id"]}
INSERT_KEYS = {"links": ["source_table", "source_id"], "aliases": ["entity_id", "normalized_title", "source_table", "source_id"]}


def commit(tables: dict[str, DataFrame], candidates: DataFrame, *, specs: list[tuple[str, str]] | None = None, run_id: str = "") -> dict[str, DataFrame]:
    """The tables entities, golden, links, aliases, decisions and log after the ``changes`` of the candidates."""
    out = {}
    for n, df in changes(tables["links"], candidates, specs=specs, run_id=run_id).items():
        if n in UPSERT_KEYS:
            out[n] = upsert(tables[n], df, UPSERT_KEYS[n])
        elif n in INSERT_KEYS:
            out[n] = insert_missing(tables[n], df, INSERT_KEYS[n])
        else:
            out[n] = tables[n].unionByName(df, allowMissingColumns=True) if n in tables else df
    return out


def master_view(golden: DataFrame, entities: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """One row per golden record: id, a column for each of (output, source), status, selected_source_table, confidence.

    A value comes from the payload's master record, else from the candidate's
    attributes, second and first side and their attributes, else from the
    golden record.
    """
    columns = []
    for output, source in specs:
        p = F.col("g.source_payload")
        last = F.col("g.title") if output in ("title", "name") else F.col(f"g.{source}").cast("string") if source in ("manufacturer", "price") else F.lit(None).cast("string")
        paths = [("master_record", output), ("candidate", "attributes", source), *[("candidate", t, *rest, source) for t in ("table2", "table1") for rest in (("attributes",), ())]]
        tries = [json_value(p, *path) for path in paths]
        columns.append(F.coalesce(*tries, last).alias(output))
    both = golden.alias("g").join(entities.alias("e"), F.col("g.entity_id") == F.col("e.entity_id"))
    return both.select(F.col("g.entity_id").alias("id"), *columns, F.col("e.status").alias("status"), F.col("g.selected_source_table").alias("selected_source_table"), F.col("g.confidence").alias("confidence"))


def backfill(entities: DataFrame, golden: DataFrame, aliases: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and golden records with valid lineage labels and states in place of missing or wrong ones.

    The label is that of the first alias with the entity's title, else of the
    first link with it, else of the first link at all, else unknown; links
    carry their title.  ``selected_source_table`` may be missing as a column.
    """
    for name in ("selected_source_table", "status"):
        if name not in entities.columns:
            entities = entities.withColumn(name, F.lit(None).cast("string"))
    if "selected_source_table" not in golden.columns:
        golden = golden.withColumn("selected_source_table", F.lit(None).cast("string"))
    own = entities.select("entity_id", normalize_text(F.col("canonical_title")).alias("__t"))
    order = F.struct("source_table", "source_id")
    named = aliases.join(own, "entity_id").where((F.col("__t") != "") & (normalize_text(F.col("alias_title")) == F.col("__t"))).withColumn("l", source_label(F.col("source_table")))
    by_alias = named.where("l is not null").groupBy("entity_id").agg(F.min_by("l", order).alias("__a"))
    linked = links.join(own, "entity_id").withColumns({"l": F.coalesce(source_label(F.col("source_table")), F.lit("unknown")), "same": (F.col("__t") != "") & (normalize_text(F.col("title")) == F.col("__t"))})
    by_link = linked.groupBy("entity_id").agg(F.min_by("l", F.when(F.col("same"), order)).alias("__s"), F.min_by("l", order).alias("__f"))
    found = own.select("entity_id").join(by_alias, "entity_id", "left").join(by_link, "entity_id", "left").select("entity_id", F.coalesce("__a", "__s", "__f", F.lit("unknown")).alias("__label"))
    sources = golden.groupBy("entity_id").agg(F.min("source").alias("__source"))
    fixed = entities.join(found, "entity_id", "left").join(sources, "entity_id", "left")
    label = F.when(F.col("selected_source_table").isin(LABELS), F.col("selected_source_table")).otherwise(F.col("__label"))
    state = F.when(F.col("status").isin(STATUSES), F.col("status")).when(F.col("__source") == "llm", "llm_active").otherwise("backend_active")
    fixed = fixed.withColumns({"selected_source_table": label, "status": state}).select(*entities.columns)
    of = fixed.select("entity_id", F.col("selected_source_table").alias("__of"))
    right = golden.join(of, "entity_id", "left").withColumn("selected_source_table", F.when(F.col("selected_source_table").isin(LABELS), F.col("selected_source_table")).otherwise(F.col("__of"))).select(*golden.columns)
    return fixed, right
