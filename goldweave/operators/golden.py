"""Survivorship, master tables and their repair, all as batch DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.text import normalize_text

# Titles too general to identify an entity.
UNSAFE_KEYS = ("software", "quickbooks r", "deposit slips")


def present(value: Column) -> Column:
    """``value`` or null for blanks."""
    return F.when(F.trim(value.cast("string")) != "", value)


def pair_title(l_title: Column, r_title: Column) -> Column:
    """The title whose normal form is longer; the left one on a tie."""
    return F.when(F.length(normalize_text(r_title)) > F.length(normalize_text(l_title)), r_title).otherwise(l_title)


def selected_side(title: Column, l_title: Column, r_title: Column) -> Column:
    norm = normalize_text(title)
    return F.when(norm == normalize_text(l_title), "table1").when(norm == normalize_text(r_title), "table2")


def surviving(side: Column, bare: Column, left: Column, right: Column) -> Column:
    """The selected side's value, else the bare one, else the left, else the right."""
    own = F.when(side == "table1", left).when(side == "table2", right)
    return F.coalesce(present(own), present(bare), present(left), present(right))


def canonical_titles(members: DataFrame) -> DataFrame:
    """(entity_id, title): of the members' titles the longest by normal form, the first by ``pos`` on a tie."""
    size = F.length(normalize_text(F.col("title")))
    return members.where(present(F.col("title")).isNotNull()).groupBy("entity_id").agg(F.max_by("title", F.struct(size, -F.col("pos"))).alias("title"))


def source_label(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("table1", "table_a", "tablea"), "tableA").when(low.isin("table2", "table_b", "tableb"), "tableB").when(low == "incoming", "incoming")


def status_for(source: Column) -> Column:
    return F.when(source == "uncertain", "uncertain").when(source == "llm", "llm_active").otherwise("backend_active")


def unmatched(source: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows of ``source`` whose id is in no cluster."""
    return source.join(matched.select("id").distinct(), "id", "left_anti")


def unlinked(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Rows (source_id, ...) of the source table ``name`` that no entity holds."""
    return rows.join(links.where(F.col("source_table") == name).select("source_id"), "source_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same keys; files have no MERGE."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys are not there, one for each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def entity_table(rows: DataFrame, source: str) -> DataFrame:
    """Entities of single rows (entity_id, title, manufacturer, price)."""
    return rows.select(
        "entity_id", F.coalesce(present(F.col("title")), F.lit("untitled")).alias("canonical_title"), "manufacturer", "price",
        status_for(F.lit(source)).alias("status"), F.lit(1.0).alias("confidence"), F.current_timestamp().alias("created_at"),
    )


def golden_from_entities(entities: DataFrame) -> DataFrame:
    """One golden row for each entity; its attributes, where the table has them, are the payload's master record."""
    record = [F.col("attributes").alias("master_record")] if "attributes" in entities.columns else []
    payload = F.to_json(F.struct(F.col("canonical_title").alias("title"), "manufacturer", "price", *record))
    return entities.select("entity_id", F.col("canonical_title").alias("title"), "manufacturer", "price", payload.alias("source_payload"), F.lit("entity_snapshot").alias("source"), "confidence")


def golden_read(golden: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """Golden rows with their sorted aliases and links; both are grouped before they are joined."""
    a = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias_title")).alias("aliases"))
    l = links.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "source_table", "source_id"))).alias("links"))  # noqa: E741
    none = F.array().cast("array<string>")
    out = golden.join(a, "entity_id", "left").join(l, "entity_id", "left")
    return out.withColumns({"aliases": F.coalesce("aliases", none), "links": F.coalesce("links", none)})


def golden_csv(golden: DataFrame, aliases: DataFrame) -> DataFrame:
    a = aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias_title")), " | ").alias("aliases"))
    return golden.join(a, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def page(df: DataFrame, key: str, *, limit: int = 100, offset: int = 0, ascending: bool = True) -> DataFrame:
    limit, offset = min(max(limit, 1), 10_000), max(offset, 0)
    return df.orderBy(F.asc(key) if ascending else F.desc(key)).offset(offset).limit(limit)


def safe_key(norm: Column) -> Column:
    return (F.length(norm) >= 6) & (F.size(F.filter(F.split(norm, " "), lambda t: t != "")) >= 1) & ~norm.isin(*UNSAFE_KEYS)


def duplicate_titles(entities: DataFrame) -> DataFrame:
    """(entity_id, keep): entities of one title in lower case, with the smallest id to keep; safe titles only."""
    key = F.lower(F.trim("canonical_title"))
    safe = entities.where(safe_key(normalize_text(F.col("canonical_title")))).select("entity_id", key.alias("k"))
    keep = safe.groupBy("k").agg(F.min("entity_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    return safe.join(keep.select("k", "keep"), "k").where("entity_id <> keep").select("entity_id", "keep")


def safe_alias_groups(entities: DataFrame, aliases: DataFrame, *, spread: float = 0.5) -> DataFrame:
    """(normalized_title, keep, members) of aliases of several entities with one maker at most and near prices."""
    own = aliases.where(safe_key(F.col("normalized_title"))).select("normalized_title", "entity_id").distinct().join(entities.select("entity_id", "manufacturer", "price"), "entity_id")
    maker = F.when(present(F.col("manufacturer")).isNotNull(), normalize_text(F.col("manufacturer")))
    g = own.groupBy("normalized_title").agg(
        F.min("entity_id").alias("keep"), F.array_sort(F.collect_set("entity_id")).alias("members"), F.count_distinct(maker).alias("makers"), F.min("price").alias("lo"), F.max("price").alias("hi"),
    )
    near = F.coalesce((F.col("hi") - F.col("lo")) / F.when(F.col("hi") > 0, F.col("hi")) <= spread, F.lit(True))
    return g.where((F.size("members") > 1) & (F.col("makers") <= 1) & near).select("normalized_title", "keep", "members")


_MERGED = ("entity_id", "canonical_title", "manufacturer", "price", "confidence", "attributes")


def merge_decisions(remap: DataFrame, run_id: str, reason: str) -> DataFrame:
    """A decision row for each entity that went into another."""
    return remap.select(
        F.lit(run_id).alias("run_id"), F.lit("").alias("cluster_id"), F.concat(F.lit("entity:"), F.col("keep").cast("string")).alias("left_id"),
        F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("right_id"), F.lit("same_entity").alias("decision"), F.lit(1.0).alias("confidence"), F.lit(reason).alias("reason"),
    )


def merge_entities(entities: DataFrame, aliases: DataFrame, links: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after each ``entity_id`` of ``remap`` has gone into its ``keep``.

    The longest title, the first maker, price and value of each attribute, and
    the highest confidence survive.
    """
    to = F.coalesce("keep", "entity_id")
    moved = entities.join(remap, "entity_id", "left").withColumn("to", to)
    size = F.length(normalize_text(F.col("canonical_title")))
    first = lambda c: F.min_by(c, F.when(present(F.col(c)).isNotNull(), F.col("entity_id")))
    merged = moved.groupBy(F.col("to").alias("entity_id")).agg(
        F.min_by("canonical_title", F.struct(-size, "entity_id")).alias("canonical_title"), first("manufacturer").alias("manufacturer"), first("price").alias("price"),
        F.max("confidence").alias("confidence"), *[F.min_by(c, "entity_id").alias(c) for c in entities.columns if c not in _MERGED],
    )

    if "attributes" in entities.columns:
        # Attributes are merged as rows, so that no list grows with the entities of one title.
        each = moved.select("to", "entity_id", F.explode("attributes").alias("k", "v")).where(present(F.col("v")).isNotNull())
        each = each.groupBy(F.col("to").alias("entity_id"), "k").agg(F.min_by("v", "entity_id").alias("v"))
        kept = each.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
        merged = merged.join(kept, "entity_id", "left").select(*entities.columns)

    def follow(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.join(remap, "entity_id", "left").withColumn("entity_id", to).drop("keep").dropDuplicates(keys)

    return merged, follow(aliases, ["entity_id", "normalized_title", "source_table", "source_id"]), follow(links, ["source_table", "source_id"])


def alias_remap(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, keep) of safe alias groups that share no entity with a group of a smaller title."""
    groups = safe_alias_groups(entities, aliases)
    each = groups.select("normalized_title", "keep", F.explode("members").alias("entity_id"))
    first = F.min("normalized_title").over(Window.partitionBy("entity_id"))
    clean = each.withColumn("own", first == F.col("normalized_title")).groupBy("normalized_title").agg(F.min("own").alias("all_own")).where("all_own")
    return each.join(clean.select("normalized_title"), "normalized_title", "left_semi").where("entity_id <> keep").select("entity_id", "keep")


def merge_duplicate_aliases(entities: DataFrame, aliases: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge safe alias groups until none is left; a round takes groups that share no entity, in title order.

    The group of the smallest title is always among them, so each round merges
    some and the rounds end.
    """
    from goldweave.operators.graph import settled

    while True:
        remap = settled(alias_remap(entities, aliases))
        if remap.isEmpty():
            return entities, aliases, links
        entities, aliases, links = (settled(t) for t in merge_entities(entities, aliases, links, remap))


def chart_series(entities: DataFrame, decisions: DataFrame, links: DataFrame) -> DataFrame:
    """(series, label, n): entities by the table of their title and by state, decisions, source rows by table, and entities by their links.

    Nulls count as ``unknown``.
    """
    of = lambda df, c, name: df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n")).select(F.lit(name).alias("series"), "label", "n")
    sizes = entities.select("entity_id").join(links.groupBy("entity_id").agg(F.count("*").alias("k")), "entity_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    parts = [
        of(entities, "selected_source_table", "selected_source_table"), of(entities, "status", "status"), of(decisions, "decision", "decision"), of(links, "source_table", "source_table"),
        of(sizes, "k", "links_of_entity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_quality(entities: DataFrame, golden: DataFrame, links: DataFrame, aliases: DataFrame, decisions: DataFrame, *, expected_a: int | None = None, expected_b: int | None = None) -> DataFrame:
    """One row of counts, coverage and ``valid``.

    Expected counts of source rows, where they are known, must equal the
    links; repeated titles and aliases and uncertain decisions are told but
    don't make the master invalid.
    """
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1").agg(F.count("*"))
    one = entities.agg(F.count("*").alias("entities"))
    of = lambda t: F.count_if(F.col("source_table") == t)
    parts = [
        golden.agg(F.count("*").alias("golden_records"), F.count_if(F.col("entity_id").isNull()).alias("null_golden_entity_ids")),
        twice(golden.where("entity_id is not null"), "entity_id").toDF("duplicate_golden_entity_ids"),
        twice(links, "source_table", "source_id").toDF("duplicate_source_links"),
        aliases.where("normalized_title <> ''").groupBy("normalized_title").agg(F.count_distinct("entity_id").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_aliases")),
        twice(entities.select(F.lower(F.trim("canonical_title")).alias("t")).where("t <> ''"), "t").toDF("duplicate_titles"),
        decisions.agg(F.count_if(F.col("decision") == "uncertain").alias("uncertain_decisions")),
        links.agg(of("table1").alias("links_a"), of("table2").alias("links_b"), of("incoming").alias("links_incoming")),
    ]
    for p in parts:
        one = one.crossJoin(p)  # single rows
    covered = lambda c, n: F.lit(True) if n is None else F.col(c) == n
    one = one.withColumns({"coverage_a": covered("links_a", expected_a), "coverage_b": covered("links_b", expected_b)})
    ok = (F.col("entities") == F.col("golden_records")) & (F.col("duplicate_golden_entity_ids") == 0) & (F.col("null_golden_entity_ids") == 0) & (F.col("duplicate_source_links") == 0)
    return one.withColumn("valid", ok & F.col("coverage_a") & F.col("coverage_b"))


def text_fields(records: DataFrame, fields: list[str]) -> Column:
    """All texts of the fields as one array; a field may be an array of texts, such as the aliases."""
    kinds = dict(records.dtypes)
    return F.concat(*[F.coalesce(F.col(f), F.array().cast("array<string>")) if kinds[f].startswith("array") else F.array(F.col(f).cast("string")) for f in fields])


def rule_score(c: Column, i: Column, q: Column) -> Column:
    """The score of a query for a field's compact text and initials: exact, prefix, contained, initials, characters; null for none."""
    every = F.forall(F.split(q, ""), lambda x: F.contains(c, x))
    return (
        F.when((c == "") | (q == ""), None).when(c == q, 1.0).when(F.startswith(c, q), 0.94).when(F.contains(c, q), 0.86)
        .when(F.startswith(i, q), 0.78).when(F.contains(i, q), 0.70).when(every, 0.48)
    )


def search(records: DataFrame, query: str, fields: list[str], *, limit: int = 10) -> DataFrame:
    """Records by the best rule over their fields, from a scan of all of them; ``search_index`` answers many queries at once."""
    from goldweave.functions.text import compact, initials

    q = compact(F.lit(query))
    best = F.array_max(F.transform(text_fields(records, fields), lambda x: rule_score(compact(F.coalesce(x, F.lit(""))), initials(F.coalesce(x, F.lit(""))), q)))
    return records.withColumn("score", best).where("score is not null").orderBy(F.desc("score"), F.desc("confidence"), "entity_id").limit(min(max(limit, 1), 100))
