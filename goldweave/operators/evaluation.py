"""Linkage quality: pair and cluster measures, curves and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.text import folded
from goldweave.operators.cells import join_in_cells
from goldweave.operators.graph import AUTO, MARGIN, running_sums, with_margins


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)}


def prf(labeled: DataFrame, score: str, threshold: float) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of ``score >= threshold`` against ``label``."""
    hit, pos = F.col(score) >= threshold, F.col("label") == 1
    c = labeled.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    return c.select("tp", "fp", "fn", *[v.alias(k) for k, v in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def threshold_sweep(labeled: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """Measures for each threshold in one pass: each row counts for the thresholds up to its score."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    pos = (F.col("label") == 1).cast("long")
    each = labeled.select(F.explode(grid).alias("threshold"), F.col(score).alias("s"), pos.alias("pos"))
    hit = F.col("s") >= F.col("threshold")
    c = each.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, 1 - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn")
    )
    return c.select("threshold", "tp", "fp", "fn", *[v.alias(k) for k, v in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def _by_score(labeled: DataFrame, score: str) -> DataFrame:
    pos = (F.col("label") == 1).cast("long")
    return labeled.groupBy(F.col(score).alias("s")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))


def roc_auc(labeled: DataFrame, score: str) -> DataFrame:
    """Area under the curve by ranks with ties averaged, from counts per distinct score."""
    c = running_sums(_by_score(labeled, score), "s", ["n"])
    good = F.sum(F.col("p") * (F.col("upto_n") - F.col("n") / 2))
    return c.agg(F.round(good / (F.sum("p") * F.sum("n")), 6).alias("roc_auc"))


def average_precision(labeled: DataFrame, score: str) -> DataFrame:
    """Sum of precision at each distinct score times the recall that it adds."""
    c = running_sums(_by_score(labeled, score), "s", ["p", "n"])
    # What stands at a score or above it.
    above = lambda v: F.col(f"all_{v}") - F.col(f"upto_{v}") + F.col(v)
    tp = above("p")
    return c.agg(F.round(F.sum(tp / (tp + above("n")) * F.col("p")) / F.sum("p"), 6).alias("average_precision"))


def score_quantiles(scored: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """(q, score): for each share the score at place floor((n - 1) * q) of the rising order."""
    counts = running_sums(scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("k")), "s", ["k"])
    each = counts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    at = F.floor((F.col("all_k") - 1) * F.col("q"))
    return each.where((F.col("upto_k") > at) & (F.col("upto_k") - F.col("k") <= at)).select("q", F.col("s").alias("score"))


# Rules by which scored pairs are taken, and the thresholds that they are tried with.
RULES = ["all_above", "mutual_top_1to1", "mutual_top_margin_1to1"]
THRESHOLDS = [0.95, 0.94, 0.92, 0.90, 0.88, 0.85, 0.82, 0.80, 0.78, 0.75, 0.72, 0.70, 0.68, 0.65, 0.60]


def rule_sweep(scored: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS, margins: list[float] = (MARGIN,), *, high: float = AUTO) -> DataFrame:
    """Measures of each rule for every threshold, and of the margin rule for every margin, against the pairs of ``truth``.

    All pairs of a threshold count; or those that are the best of both ends;
    or of these the ones below ``high``, without a conflict, that lead at both
    ends by the margin.  A pair survives up to one threshold and one margin,
    so it is counted once, in the cell of the last ones it survives, and sums
    over the grid from its far end give all measures: the pairs are read once
    whatever the grid's size.
    """
    grid_t, grid_m = sorted({float(t) for t in thresholds}), sorted({float(m) for m in margins})
    known = truth.select("l_id", "r_id").distinct().withColumn("__y", F.lit(1))
    rows = with_margins(scored).join(known, ["l_id", "r_id"], "left")
    both = (F.col("l_rank") == 1) & (F.col("r_rank") == 1)
    lead = F.least("l_margin", "r_margin")
    last = lambda grid, v: sum((F.when(v >= g, 1).otherwise(0) for g in grid), F.lit(0))
    held = [
        F.struct(F.lit(0).alias("rule"), F.lit(0).alias("j")),
        F.when(both, F.struct(F.lit(1).alias("rule"), F.lit(0).alias("j"))),
        F.when(both & (F.col("confidence") < high) & ~F.col("conflict"), F.struct(F.lit(2).alias("rule"), last(grid_m, lead).alias("j"))),
    ]
    each = rows.select(F.explode(F.array_compact(F.array(*held))).alias("h"), last(grid_t, F.col("confidence")).alias("i"), F.coalesce("__y", F.lit(0)).alias("y"))
    cells = each.select("h.*", "i", "y").groupBy("rule", "i", "j").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    # The grid has one row for each rule, threshold and margin.
    points = [(r, i + 1, t, j + (r == 2), m if r == 2 else None) for r in range(3) for i, t in enumerate(grid_t) for j, m in enumerate(grid_m if r == 2 else [None])]
    grid = scored.sparkSession.createDataFrame(points, "rule int, i int, threshold double, j int, margin double")
    found = grid.alias("g").join(cells.alias("c"), (F.col("g.rule") == F.col("c.rule")) & (F.col("c.i") >= F.col("g.i")) & (F.col("c.j") >= F.col("g.j")), "left")
    sums = found.groupBy("g.rule", "g.threshold", "g.margin").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("predicted"))
    out = sums.crossJoin(F.broadcast(known.agg(F.count("*").alias("total"))))  # one row
    fp, fn = F.col("predicted") - F.col("tp"), F.col("total") - F.col("tp")
    rule = F.get(F.array(*[F.lit(r) for r in RULES]), F.col("rule")).alias("rule")
    return out.select(rule, "threshold", "margin", "tp", fp.alias("fp"), fn.alias("fn"), *[v.alias(k) for k, v in precision_recall(F.col("tp"), fp, fn).items()], "predicted")


def cluster_keys(links: DataFrame) -> DataFrame:
    """One text per entity that names all its references; of two or more references."""
    key = F.array_join(F.array_sort(F.collect_set("ref")), "|")
    return links.groupBy("entity_id").agg(key.alias("members"), F.count_distinct("ref").alias("size")).where("size > 1").select("members")


def cluster_exact(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    a, b = cluster_keys(predicted).distinct(), cluster_keys(truth).distinct()
    both = a.join(b, "members", "left_semi").agg(F.count("*").alias("exact"))
    counts = both.crossJoin(a.agg(F.count("*").alias("predicted"))).crossJoin(b.agg(F.count("*").alias("truth")))  # single rows
    return counts.select("exact", "predicted", "truth", F.round(F.col("exact") / F.greatest("predicted", F.lit(1)), 6).alias("precision"), F.round(F.col("exact") / F.greatest("truth", F.lit(1)), 6).alias("recall"))


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    found = truth.join(candidates.select("l_id", "r_id").distinct().withColumn("hit", F.lit(1)), ["l_id", "r_id"], "left")
    return found.agg(F.count("hit").alias("found"), F.count("*").alias("total"), F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))


def accuracy(labeled: DataFrame, score: str, threshold: float) -> DataFrame:
    """The measures of ``prf`` with the share of right verdicts and the number of positive ones."""
    hit, pos = F.col(score) >= threshold, F.col("label") == 1
    more = labeled.agg(F.round(F.avg((hit == pos).cast("double")), 6).alias("accuracy"), F.count_if(hit).alias("predicted_positive"))
    return prf(labeled, score, threshold).crossJoin(more)  # single rows


def labeled_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Labeled pairs of ids with both rows; pairs of which a side is missing are left out."""
    side = lambda df, p: df.select(*[F.col(f"`{c}`").alias(f"{p}_{c}") for c in df.columns])
    return pairs.join(side(left, "l"), "l_id").join(side(right, "r"), "r_id")


def clusters_of(links: DataFrame) -> DataFrame:
    """(entity_id, members) of links(entity_id, ref): all references of an entity as one sorted text, singletons as well."""
    return links.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), "|").alias("members"))


def _with_entities(links: DataFrame, name: str) -> DataFrame:
    """(ref, name): the entities of each reference, sorted; null ones don't count."""
    return links.where("ref is not null").groupBy("ref").agg(F.array_sort(F.collect_set("entity_id")).alias(name))


def _first_common(l: Column, r: Column, entity: Column) -> Column:  # noqa: E741
    """Whether ``entity``, which both arrays hold, is the first one that they do: so each pair counts once."""
    return (F.size(l) == 1) | (F.size(r) == 1) | (F.array_min(F.array_intersect(l, r)) == entity)


def cross_pairs(links: DataFrame) -> DataFrame:
    """Distinct (l_id, r_id) of references to table1 and table2 within each entity.

    A pair comes from the first entity that both references share, so pairs
    are neither shuffled nor compared.  Large entities are dealt into cells of
    their two sides.
    """
    refs = _with_entities(links, "es")
    # A reference of one entity brings no array.
    several = F.when(F.size("es") > 1, F.col("es"))
    of = lambda t, p: refs.where(F.startswith("ref", F.lit(f"{t}:"))).select(F.expr(f"substring(ref, {len(t) + 2})").alias(f"{p}_id"), several.alias(f"{p}_es"), F.explode("es").alias("entity_id"))
    l, r = of("table1", "l"), of("table2", "r")  # noqa: E741
    one = F.col("l_es").isNull() | F.col("r_es").isNull()
    return join_in_cells(l, r, "entity_id", "l_id", "r_id").where(one | _first_common(F.col("l_es"), F.col("r_es"), F.col("entity_id"))).select("l_id", "r_id")


def _pair_total(refs: DataFrame, names: list[str], total: str) -> DataFrame:
    """One row: how many pairs of table1 and table2 share an entity in each of the array columns ``names``.

    References of the same entities are one class, and pairs of classes count
    the product of their sizes; no pair of references is made.
    """

    def side(t: str, p: str) -> DataFrame:
        out = refs.where(F.startswith("ref", F.lit(f"{t}:"))).groupBy(*names).agg(F.count("*").alias(f"{p}_n")).withColumnsRenamed({n: f"{p}_{n}" for n in names})
        for n in names:
            out = out.withColumn(f"e_{n}", F.explode(f"{p}_{n}"))
        return out

    met = side("table1", "l").join(side("table2", "r"), [f"e_{n}" for n in names])
    for n in names:
        met = met.where(_first_common(F.col(f"l_{n}"), F.col(f"r_{n}"), F.col(f"e_{n}")))
    return met.agg(F.coalesce(F.sum(F.col("l_n") * F.col("r_n")), F.lit(0)).alias(total))


def cross_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``pair_counts`` of the cross pairs of two sets of links, from counts of references."""
    refs = _with_entities(predicted, "p").join(_with_entities(truth, "t"), "ref", "full")
    both, p, t = _pair_total(refs, ["p", "t"], "tp"), _pair_total(refs, ["p"], "ps"), _pair_total(refs, ["t"], "ts")
    out = both.crossJoin(p).crossJoin(t)  # single rows
    return out.select("tp", (F.col("ps") - F.col("tp")).alias("fp"), (F.col("ts") - F.col("tp")).alias("fn"))


def pair_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, tp, fp and fn: pairs (l_id, r_id) in both, in the first and in the second only; repeated pairs count once."""
    keys = ["l_id", "r_id"]
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def shapes(links: DataFrame) -> DataFrame:
    """(shape, n): how many entities hold rows of one table or of both, one of each or more."""
    of = lambda t: F.count_if(F.col("source_table") == t)
    each = links.groupBy("entity_id").agg(of("table1").alias("a"), of("table2").alias("b"))
    a, b = F.col("a"), F.col("b")
    shape = F.when((a == 1) & (b == 1), "merged_1x1").when((a > 0) & (b > 0), "merged_multi").when(a > 0, "only_a").when(b > 0, "only_b").otherwise("none")
    return each.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def eval_report(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: clusters, coverage of both sources, exact clusters, pair measures and titles of predicted links against a reference.

    ``predicted`` has entity_id and ref, ``truth`` also title, ``entities``
    entity_id and canonical_title.
    """
    p, t = clusters_of(predicted), clusters_of(truth)
    titles = truth.groupBy("entity_id").agg(F.min("title").alias("title"))
    p = p.join(entities.select("entity_id", "canonical_title"), "entity_id", "left").groupBy("members").agg(F.min("canonical_title").alias("p_title"))
    t = t.join(titles, "entity_id", "left").groupBy("members").agg(F.min("title").alias("t_title"))
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), "members", "full")
    x, y = folded(F.col("p_title")), folded(F.col("t_title"))
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    out = both.agg(
        F.count("t").alias("reference_clusters"), F.count("p").alias("predicted_clusters"), F.count_if(hit).alias("exact_clusters"),
        F.count_if(hit & ((x != "") | (y != ""))).alias("titles_compared"), F.count_if(hit & ((x != "") | (y != "")) & (x == y)).alias("titles_equal"),
    )
    refs = predicted.select("ref").distinct().withColumn("p", F.lit(1)).join(truth.select("ref").distinct().withColumn("t", F.lit(1)), "ref", "full")
    for name, table in (("a", "table1"), ("b", "table2")):
        own = F.startswith("ref", F.lit(f"{table}:"))
        seen = refs.where(own).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias(f"{name}_covered"), F.count_if(F.col("p").isNull()).alias(f"{name}_missing"), F.count_if(F.col("t").isNull()).alias(f"{name}_extra"))
        out = out.crossJoin(seen)  # single rows
    out = out.crossJoin(cross_counts(predicted, truth))
    c = F.col
    return out.withColumns(
        {
            "cluster_precision": _share(c("exact_clusters"), c("predicted_clusters")), "cluster_recall": _share(c("exact_clusters"), c("reference_clusters")),
            "a_recall": _share(c("a_covered"), c("a_covered") + c("a_missing")), "b_recall": _share(c("b_covered"), c("b_covered") + c("b_missing")),
            "title_rate": _share(c("titles_equal"), c("titles_compared")), **precision_recall(c("tp"), c("fp"), c("fn")),
        }
    )


def mismatches(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(side, members) of clusters that only one of the two has, the missing ones first."""
    p, t = clusters_of(predicted).select("members").distinct(), clusters_of(truth).select("members").distinct()
    one = lambda a, b, name: a.join(b, "members", "left_anti").select(F.lit(name).alias("side"), "members")
    return one(t, p, "missing_reference_cluster").unionByName(one(p, t, "extra_predicted_cluster")).orderBy(F.desc("side"), "members")


def mismatch_rows(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(side, refs, reference_title, predicted_entity_id, predicted_title) of clusters that only one of the two has, the missing ones first."""
    named = truth.groupBy("entity_id").agg(F.min("title").alias("reference_title"))
    t = clusters_of(truth).join(named, "entity_id").select(F.col("members").alias("refs"), "reference_title")
    p = clusters_of(predicted).join(entities.select("entity_id", F.col("canonical_title").alias("predicted_title")), "entity_id", "left").select(F.col("members").alias("refs"), F.col("entity_id").alias("predicted_entity_id"), "predicted_title")
    missing = t.join(p.select("refs"), "refs", "left_anti").withColumn("side", F.lit("missing_reference_cluster"))
    out = missing.unionByName(p.join(t.select("refs"), "refs", "left_anti").withColumn("side", F.lit("extra_predicted_cluster")), allowMissingColumns=True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return out.select("side", "refs", text("reference_title"), text("predicted_entity_id"), text("predicted_title")).orderBy(F.desc("side"), "refs")


def case_summary(cases: DataFrame) -> DataFrame:
    """What each run of a whole workflow came to: coverage of both tables, and whether it passed.

    ``cases`` has case, positive, relation_type, ingest_status, quality_valid,
    links_a, links_b, rows_a and rows_b.  A pair of tables of one kind passes
    if it is not rejected and its master is valid; other pairs pass if they
    are rejected.
    """
    rejected = F.coalesce(F.col("relation_type") == "dataset_type_mismatch", F.lit(False)) | F.coalesce(F.col("ingest_status") == "reupload_required", F.lit(False))
    share = lambda n, of: F.round(F.when(F.col(of) > 0, F.coalesce(n, F.lit(0)) / F.col(of)).otherwise(0.0), 6)
    return cases.select(
        "case", F.when(F.col("positive"), "positive").otherwise("negative").alias("expected"),
        F.when(F.col("positive"), ~rejected & F.coalesce("quality_valid", F.lit(False))).otherwise(rejected).alias("passed"), rejected.alias("rejected"),
        share(F.col("links_a"), "rows_a").alias("coverage_a"), share(F.col("links_b"), "rows_b").alias("coverage_b"),
    )


def weight_grid(names: list[str], step: int = 5) -> list[tuple[float, ...]]:
    """All weights of the names in steps of ``step`` percent that sum to one."""
    units = 100 // step

    def rest(n: int, left: int) -> list[tuple[int, ...]]:
        return [(left,)] if n == 1 else [(k, *x) for k in range(left + 1) for x in rest(n - 1, left - k)]

    return [tuple(k * step / 100 for k in x) for x in rest(len(names), units)]


def tune_weights(labeled: DataFrame, names: list[str], *, step: int = 5, thresholds: list[float] | None = None) -> DataFrame:
    """The weights and the threshold of the best F1, one row.

    Each row is counted once for each weighting in the bin of its mixed score
    between two thresholds; the counts of bins, at most weightings x
    thresholds x 2 rows, then give every threshold's measures.
    """
    thresholds = thresholds or [k / 100 for k in range(5, 96)]
    grid = weight_grid(names, step)
    weights = F.array(*[F.struct(F.lit(i).alias("g"), F.array(*[F.lit(w) for w in ws]).alias("w")) for i, ws in enumerate(grid)])
    steps = F.array(*[F.lit(t) for t in thresholds])
    each = labeled.select((F.col("label") == 1).alias("pos"), *names, F.explode(weights).alias("__x"))
    mixed = F.lit(0.0)
    for i, n in enumerate(names):
        mixed = mixed + F.get("__x.w", i) * F.col(n)
    at = F.size(F.filter(steps, lambda t: mixed >= t))
    counts = each.groupBy("__x.g", at.alias("upto")).agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    # A row whose score reaches the first k thresholds counts for each of them.
    w = Window.partitionBy("g").orderBy(F.desc("upto")).rangeBetween(Window.unboundedPreceding, 0)
    ladder = labeled.sparkSession.createDataFrame([(g, k + 1) for g in range(len(grid)) for k in range(len(thresholds))], "g int, upto int").withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    summed = counts.select("g", F.col("upto").cast("int").alias("upto"), "p", "n").unionByName(ladder).groupBy("g", "upto").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    all_p = F.sum("p").over(Window.partitionBy("g"))
    scored = summed.select("g", "upto", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), all_p.alias("all")).where("upto > 0")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all"))).otherwise(0.0)
    best = scored.withColumn("f1", f1).agg(F.max(F.struct("f1", (-F.col("g")).alias("g"), (-F.col("upto")).alias("k"))).alias("b"))
    table = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in grid])
    row = best.select(F.round("b.f1", 6).alias("f1"), F.get(steps, -F.col("b.k") - 1).alias("threshold"), F.get(table, -F.col("b.g")).alias("w"))
    return row.select(*[F.get("w", i).alias(f"w_{n}") for i, n in enumerate(names)], "threshold", "f1")
