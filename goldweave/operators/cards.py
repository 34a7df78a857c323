"""Field profiles and cards of datasets, and the preparation of labeled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.numeric import clean_price
from goldweave.functions.text import clean_quotes, clean_scalar, field_name
from goldweave.operators.graph import rank_rows

# Words in a dataset's name or fields that tell its kind of entity, in this order.
ENTITY_HINTS = [
    (["beer", "brew", "abv"], "beer"),
    (["dblp", "acm", "scholar", "authors", "venue"], "publication"),
    (["itunes", "song", "artist", "album", "music"], "music"),
    (["fodors", "zagats", "restaurant", "addr", "phone"], "restaurant"),
    (["company", "wiki"], "company"),
    (["amazon", "google", "walmart", "abt", "buy", "product", "manufacturer", "brand"], "product"),
]
# Fields by the way in which they are best compared.
TEXT_FIELDS = ["name", "title", "beer_name", "song_name", "description", "content", "authors", "venue"]
FUZZY_FIELDS = ["manufacturer", "brand", "brew_factory_name", "brewery", "artist_name", "album_name", "city", "phone", "genre", "style", "type", "class"]
NUMBER_FIELDS = ["price", "abv", "year", "time", "released"]
ID_FIELDS = ["id", "_id"]
# How much a field tells about an entity; others count 40.
IMPORTANCE = {
    "name": 100, "title": 100, "beer_name": 100, "song_name": 100, "content": 90, "description": 85, "manufacturer": 80, "brand": 80, "authors": 80, "artist_name": 80,
    "brew_factory_name": 75, "brewery": 75, "venue": 70, "addr": 70, "address": 70, "phone": 65, "price": 50, "year": 50, "abv": 50,
}
# Names of label columns, in this order.
LABEL_NAMES = ["label", "gold", "is_match", "match"]
# The methods that are recommended.
METHODS = {
    "id": "Do Not Match Directly; use only as record identifier", "number": "Numeric Similarity + Range Difference", "long": "Embedding Similarity + BM25",
    "text": "TF-IDF + BM25 + Embedding Similarity", "unique": "Exact Match + Fuzzy Match + Edit Distance", "token": "Exact Match + Token Similarity",
    "other": "Embedding Similarity + Token Jaccard + Edit Distance",
}
LONG_TEXT = 120


def logical_fields(*tables: DataFrame) -> list[str]:
    """Names of fields without side marks, each once, in the order in which they come."""
    return list(dict.fromkeys(field_name(c) for t in tables for c in t.columns))


def field_values(*tables: DataFrame) -> DataFrame:
    """(field, value) of all cells of the tables, white space cleaned; empty values are null."""
    parts = []
    for t in tables:
        cells = F.array(*[F.struct(F.lit(field_name(c)).alias("field"), F.nullif(clean_scalar(F.col(f"`{c}`")), F.lit("")).alias("value")) for c in t.columns])
        parts.append(t.select(F.explode(cells).alias("x")).select("x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_profile(*tables: DataFrame) -> DataFrame:
    """One row per field: counts, shares, lengths and the type of its values, over all of them."""
    v, n = F.col("value"), F.length("value")
    number = F.trim(F.regexp_replace(v, "[$,%]", "")).try_cast("double").isNotNull()
    out = field_values(*tables).groupBy("field").agg(
        F.count("*").alias("total_count"), F.count_if(v.isNull()).alias("null_count"), F.count_distinct(v).alias("unique_count"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_length"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 3).alias("avg_length"),
        F.avg(F.when(v.isNotNull(), number.cast("double"))).alias("__number"), F.avg(F.when(v.isNotNull(), (n > LONG_TEXT).cast("double"))).alias("__long"),
    )
    kind = F.when(F.col("null_count") == F.col("total_count"), "empty").when(F.col("__number") >= 0.9, "numeric").when(F.col("__long") >= 0.5, "long_text").otherwise("text")
    filled = F.col("total_count") - F.col("null_count")
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return out.select(
        "field", "total_count", "null_count", (F.col("null_count") > 0).alias("is_nullable"), share(F.col("null_count"), F.col("total_count")).alias("null_rate"), "unique_count",
        share(F.col("unique_count"), filled).alias("unique_rate"), kind.alias("data_type"), "min_length", "avg_length", "max_length",
    )


def match_method(name: Column, kind: Column, unique: Column, longest: Column) -> Column:
    """The recommended way to compare a field, from its lower-cased name and its profile."""
    text = F.when(name.isin("description", "content") | (longest > LONG_TEXT), METHODS["long"]).otherwise(METHODS["text"])
    fuzzy = F.when(unique > 0.8, METHODS["unique"]).otherwise(METHODS["token"])
    return (
        F.when(name.isin(ID_FIELDS), METHODS["id"]).when(name.isin(NUMBER_FIELDS) | (kind == "numeric"), METHODS["number"])
        .when(name.isin(TEXT_FIELDS) | (kind == "long_text"), text).when(name.isin(FUZZY_FIELDS), fuzzy).otherwise(METHODS["other"])
    )


def importance(name: Column, null_rate: Column, unique_rate: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in IMPORTANCE.items() for x in pair])[name], F.lit(40))
    return F.when(~name.isin(ID_FIELDS), base - 20 * null_rate + 5 * F.least(unique_rate, F.lit(1.0)))


def infer_entity_type(dataset: str, fields: list[str]) -> str:
    text = " ".join([dataset, *fields]).lower()
    return next((kind for hints, kind in ENTITY_HINTS if any(h in text for h in hints)), "unknown")


def dataset_cards(dataset: str, a: DataFrame, b: DataFrame, splits: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """One card per field: its profile, examples, method, importance, rank among the fields, and the text on the whole dataset.

    Examples are the values that occur most often.  The knowledge text is one
    for all cards; it names the five most important fields.
    """
    order = logical_fields(a, b)
    kind = infer_entity_type(dataset, order)
    name = F.lower("field")
    out = field_profile(a, b).withColumns(
        {
            "dataset_name": F.lit(dataset), "entity_type": F.lit(kind), "recommended_match_method": match_method(name, F.col("data_type"), F.col("unique_rate"), F.col("max_length")),
            "importance": importance(name, F.col("null_rate"), F.col("unique_rate")), "position": F.array_position(F.array(*[F.lit(x) for x in order]), F.col("field")),
            "field_description": F.concat(F.translate("field", "_-", "  "), F.lit(f": an attribute of a {kind} that helps to compare records")),
        }
    )
    counts = field_values(a, b).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("r") <= examples)
    shown = top.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("example_values"))
    out = out.join(shown, "field", "left").withColumn("example_values", F.coalesce("example_values", F.array().cast("array<string>")))
    rows = out.select("field", "importance", "recommended_match_method", "position").collect()  # one row per field
    best = [r["field"] for r in sorted((r for r in rows if r["importance"] is not None), key=lambda r: (r["importance"], r["field"]), reverse=True)[:5]]
    told = "; ".join(f"{r['field']}: {r['recommended_match_method']}" for r in sorted(rows, key=lambda r: r["position"]) if r["field"].lower() not in ID_FIELDS)
    sizes = [str(x.count()) for x in (a, b)]
    marks = "; ".join(f"{r['split']}: {r['positive']} positive, {r['negative']} negative" for r in splits.orderBy("split").collect()) if splits is not None else "none"
    text = f"Dataset {dataset} of {kind} records; tables of {sizes[0]} and {sizes[1]} rows. Fields: {', '.join(order)}. Compare first: {', '.join(best)}. Methods: {told}. Labels: {marks}."
    return out.withColumn("knowledge_text", F.lit(text))


def label_column(df: DataFrame) -> str | None:
    """The column of labels: by name, else the first whose values are all 0 or 1."""
    low = {c.lower(): c for c in reversed(df.columns)}
    named = next((low[n] for n in LABEL_NAMES if n in low), None)
    if named or not df.columns:
        return named
    value = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    row = df.agg(*[F.min(F.when(value(c).isNotNull(), value(c).isin(0.0, 1.0))).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return next((c for i, c in enumerate(df.columns) if row[i]), None)


def split_statistics(split: str, df: DataFrame) -> DataFrame:
    """(split, total, positive, negative, ratio) of labeled pairs, the ratio of positive to negative as text."""
    y = F.col(f"`{label_column(df)}`").cast("string").try_cast("double")
    out = df.agg(F.count(y).alias("total"), F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"))
    ratio = F.when(F.col("negative") == 0, F.concat(F.col("positive").cast("string"), F.lit(":0"))).otherwise(F.concat(F.round(F.col("positive") / F.col("negative"), 6).cast("string"), F.lit(":1")))
    return out.select(F.lit(split).alias("split"), "total", "positive", "negative", ratio.alias("ratio"))


def card_records(cards: DataFrame) -> DataFrame:
    """Cards as eight text columns, nested values as JSON."""
    stats = F.to_json(F.struct("is_nullable", "null_count", "total_count", "null_rate", "unique_count", "unique_rate", "data_type", "max_length", "avg_length", "min_length"))
    return cards.select(
        "dataset_name", "entity_type", F.col("field").alias("field_name"), "field_description", stats.alias("field_statistics"), F.to_json("example_values").alias("example_values"),
        "recommended_match_method", "knowledge_text",
    )


# ---- preparation ----------------------------------------------------------------


def prepared_table(df: DataFrame) -> DataFrame:
    """id, title, manufacturer and price without layers of quotes; prices positive or empty."""
    text = lambda c: clean_quotes(F.col(c)) if c in df.columns else F.lit("")
    return df.select(text("id").alias("id"), text("title").alias("title"), text("manufacturer").alias("manufacturer"), clean_price(text("price")).alias("price"))


def prepared_pairs(df: DataFrame) -> DataFrame:
    """Labeled pairs of left_ and right_ columns in the form of table1. and table2. columns, the label 1 or 0."""
    text = lambda c: clean_quotes(F.col(c)) if c in df.columns else F.lit("")
    cols = [text("id").alias("_id"), F.when(text("label") == "1", "1").otherwise("0").alias("label")]
    for name in ("id", "title", "manufacturer", "price"):
        for side, table in (("left", "table1"), ("right", "table2")):
            value = text(f"{side}_{name}")
            cols.append((clean_price(value) if name == "price" else value).alias(f"{table}.{name}"))
    return df.select(*cols)


def positive_pairs(*splits: DataFrame) -> DataFrame:
    """Distinct (left_id, right_id) that some split labels 1."""
    out = None
    for s in splits:
        one = s.where((clean_quotes(F.col("label")) == "1")).select(clean_quotes(F.col("left_id")).alias("left_id"), clean_quotes(F.col("right_id")).alias("right_id"))
        out = one if out is None else out.union(one)
    return out.where("left_id <> '' and right_id <> ''").distinct()


def truth_master(a: DataFrame, b: DataFrame, pairs: DataFrame, prefix: str = "GT") -> DataFrame:
    """Reference entities: positive pairs by their ids, then rows of A and of B without a pair; values of A go first.

    Ids are numbered in that order, in range partitions and not in one task.
    """
    order = lambda c: [F.col(c).try_cast("long"), F.col(c)]
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "title", "manufacturer", "price")])
    pick = lambda c: F.coalesce(F.nullif(F.col(f"a_{c}"), F.lit("")), F.nullif(F.col(f"b_{c}"), F.lit("")), F.lit("")).alias(c)
    both = pairs.join(side(a, "a"), F.col("left_id") == F.col("a_id"), "left").join(side(b, "b"), F.col("right_id") == F.col("b_id"), "left")
    merged = both.select(F.lit(0).alias("part"), F.col("left_id").alias("source_A_id"), F.col("right_id").alias("source_B_id"), pick("title"), pick("manufacturer"), pick("price"))
    alone = lambda df, ids, part, x, y: df.join(ids, "id", "left_anti").select(F.lit(part).alias("part"), x.alias("source_A_id"), y.alias("source_B_id"), "title", "manufacturer", "price")
    none = F.lit("")
    rows = merged.unionByName(alone(a, pairs.select(F.col("left_id").alias("id")), 1, F.col("id"), none)).unionByName(alone(b, pairs.select(F.col("right_id").alias("id")), 2, none, F.col("id")))
    keys = [F.col("part"), *order("source_A_id"), *order("source_B_id")]
    ranked = rank_rows(rows, keys, "n")
    return ranked.select(F.format_string(f"{prefix}-%05d", "n").alias("entity_id"), "title", "manufacturer", "price", "source_A_id", "source_B_id")


def dataset_summary(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: sizes, matched and unmatched rows, and ids that occur in several pairs."""
    one = a.agg(F.count("*").alias("a_rows")).crossJoin(b.agg(F.count("*").alias("b_rows")))  # single rows, here and below
    for side in ("left", "right"):
        n = pairs.groupBy(f"{side}_id").agg(F.count("*").alias("n"))
        one = one.crossJoin(n.agg(F.count("*").alias(f"matched_{side}"), F.count_if(F.col("n") > 1).alias(f"repeated_{side}")))
    one = one.crossJoin(pairs.agg(F.count("*").alias("positive_pairs")))
    return one.withColumns({"unmatched_a": F.col("a_rows") - F.col("matched_left"), "unmatched_b": F.col("b_rows") - F.col("matched_right")})


def namespaced(df: DataFrame, prefix: str, ids: list[str], columns: list[str]) -> DataFrame:
    """The columns, missing ones empty, with ``prefix:`` before the ids."""
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(*[(F.concat(F.lit(f"{prefix}:"), value(c)) if c in ids else value(c)).alias(c) for c in columns])


def mixed(parts: list[tuple[str, DataFrame]], ids: list[str], columns: list[str]) -> DataFrame:
    """The tables of several datasets as one, whose ids tell the dataset."""
    out = None
    for prefix, df in parts:
        one = namespaced(df, prefix, ids, columns)
        out = one if out is None else out.unionByName(one)
    return out


def stratified(df: DataFrame, label: str, fractions: dict, key: str, seed: int = 42) -> DataFrame:
    """Exactly the share of each label's rows (its half to even), those with the smallest hashes of seed and key.

    Labels without a fraction, and null ones, give no rows.  The last hash to
    keep is found by counts of hash prefixes, and only rows of the prefix that
    it lies in, one of 65,536, are sorted.
    """
    share = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = df.where(F.col(label).isin(list(fractions))).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("__b", F.substring("__h", 1, 4))
    bins = rows.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label).orderBy("__b")
    upto = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    want = F.bround(F.sum("__n").over(Window.partitionBy(label)) * F.element_at(share, F.col(label))).cast("long")
    cut = bins.select(label, "__b", (want - (upto - F.col("__n"))).alias("__left"), "__n").where("__left > 0")
    # Bins that are kept whole, and of each label the one in which the sample ends.
    whole = rows.join(cut.where("__left >= __n").select(label, "__b"), [label, "__b"], "left_semi")
    part = rows.join(cut.where("__left < __n").select(label, "__b", "__left"), [label, "__b"])
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__h", key))).where("__r <= __left")
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def write_cards(cards: DataFrame, path: str) -> None:
    """Cards as CSV and as JSON lines below ``path``."""
    records = card_records(cards)
    records.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    records.write.mode("overwrite").json(f"{path}/json")
