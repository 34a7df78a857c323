"""Quality rules: fixed base rules, then robust multivariate outliers.

Everything is Column expressions.  Each document gives a vector of transformed
statistics.  For every (language, source) a minimum-covariance-determinant
estimate is made by concentration steps: from the centre and scatter of a core
of the documents, distances of all are computed, and those nearest form the
next core.  The steps begin from three cores (nearest the medians in all
statistics together, in the worst of them, and nearest the mean by the scatter
of all) and go on until no determinant gets smaller; of each group's three
ends the one of the least determinant stays.  All steps are grouped sums and
counts in bins, so a group of any size is combined before it is shuffled and
never gathered, and the order of rows does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.durable import durable
from goldweave.llm.spans import let

WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Share of a group that forms the estimate, most steps of concentration, and the least group with an estimate of its own.
CORE_SHARE, STEPS, MIN_GROUP = 0.75, 12, 50
#: Bins of a factor of two of squared distances, and of one unit of a statistic.
DISTANCE_BINS, FEATURE_BINS = 64, 256
#: Squared distance beyond which a document is an outlier: five dimensions, the chi-square quantile of 1 - 1e-9.
CUTOFF = 51.0
#: Median of chi-square with five degrees of freedom, to which the median distance of a group is scaled.
CHI2_MEDIAN = 4.351
FEATURES = ["f_length", "f_word", "f_symbols", "f_lines", "f_repeat"]
_BLANKS = "[\\x20\\x09-\\x0D]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def repeated_words(windows: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window which is found twice or more.

    ``windows`` are the hashes of all windows in order.  Texts without a
    repeated hash stop at the first test.  In others windows sort by hash and
    neighbours show which repeat; those sort back by place, and each covers
    the words up to the next one, ``window`` at most.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(placed, _repeated_places)
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(_covered(repeated, window))


def _repeated_places(placed: Column) -> Column:
    marked = F.transform(
        placed, lambda p, k: F.when((F.get(placed, k - 1)["h"] == p["h"]) | (F.get(placed, k + 1)["h"] == p["h"]), p["i"])
    )
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def _covered(at: Column, window: int) -> Column:
    return F.aggregate(
        at,
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(window), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def statistics(docs: DataFrame, *, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """Id, keys (k0, k1, ...) and the counts of each document."""
    t, w = F.col("t"), F.col("w")
    out = docs.select(F.col(id_col).alias("id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    names = ["id", *[f"k{i}" for i in range(len(keys))]]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = out.select(
        *names,
        word_list(t).alias("w"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
    )
    spans = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(spans, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    out = out.select(
        *names, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"), windows.alias("h"),
    )
    return out.select(*[c for c in out.columns if c != "h"], repeated_words(F.col("h")).cast("long").alias("n_repeat_words"))


def features() -> list[Column]:
    """Transformed statistics: logarithms of sizes and damped shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.log1p(F.lit(20.0) * a / b)
    return [
        F.log1p(n).alias("f_length"),
        F.log1p(F.col("word_chars") / n).alias("f_word"),
        share(F.col("n_symbols"), n).alias("f_symbols"),
        share(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("f_lines"),
        share(F.col("n_repeat_words"), n).alias("f_repeat"),
    ]


#: Variances that are added so that a statistic that hardly varies in a group does not reject on its own.
RIDGE = {"f_length": 0.02, "f_word": 0.004, "f_symbols": 0.05, "f_lines": 0.05, "f_repeat": 0.05}


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = len(FEATURES)
    sums = [F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]]
    sums += [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


def _inverse(cells: Column, d: int) -> Column:
    """The inverse of a positive definite matrix, row by row in an array, by Gauss-Jordan steps in place."""

    def step(k: int):
        def body(a: Column) -> Column:
            pivot = F.greatest(F.get(a, k * d + k), F.lit(1e-9))
            out = []
            for i in range(d):
                for j in range(d):
                    row, col, cell = F.get(a, k * d + j), F.get(a, i * d + k), F.get(a, i * d + j)
                    if i == k:
                        out.append(F.lit(1.0) / pivot if j == k else row / pivot)
                    else:
                        out.append(-col / pivot if j == k else cell - col * row / pivot)
            return F.array(*out)

        return body

    for k in range(d):
        cells = let(cells, step(k))
    return cells


def _determinant(cells: Column, d: int) -> Column:
    """The logarithm of the determinant of a positive definite matrix: the sum of its pivots' logarithms."""

    def step(k: int):
        def body(acc: Column) -> Column:
            a = acc["a"]
            pivot = F.greatest(F.get(a, k * d + k), F.lit(1e-9))
            left = [F.get(a, i * d + j) - F.get(a, i * d + k) * F.get(a, k * d + j) / pivot if i > k and j > k else F.lit(0.0) for i in range(d) for j in range(d)]
            return F.struct(F.array(*left).alias("a"), (acc["s"] + F.log(pivot)).alias("s"))

        return body

    acc = F.struct(cells.alias("a"), F.lit(0.0).alias("s"))
    for k in range(d):
        acc = let(acc, step(k))
    return acc["s"]


def _factors(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m0, m1, ..., the inverse scatter of each group, and the logarithm of its determinant."""
    d = len(FEATURES)
    cells = []
    for i in range(d):
        for j in range(d):
            cell = F.col(f"p{max(i, j)}{min(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}")
            cells.append(F.greatest(cell, F.lit(0.0)) + RIDGE[FEATURES[i]] if i == j else cell)
    out = moments.select(*keys, *[f"m{i}" for i in range(d)], F.array(*cells).alias("scatter"))
    return out.select(*keys, *[f"m{i}" for i in range(d)], _inverse(F.col("scatter"), d).alias("inverse"), _determinant(F.col("scatter"), d).alias("determinant"))


def _match(rows: DataFrame, named: DataFrame, keys: list[str]) -> Column:
    """Equality of groups, of which nulls are some of their own; ``named`` has g_ before its keys."""
    out = F.lit(True)
    for k in keys:
        out = out & rows[k].eqNullSafe(named[f"g_{k}"])
    return out


def _quantiles(rows: DataFrame, keys: list[str], bins: dict[str, Column], shares: list[float]) -> DataFrame:
    """For each group and name of ``bins`` the least bin below which with it at least each share of the rows lies: q_<name>[i].

    Rows are counted in bins, of which a group has few, so this is exact up to
    a bin and the same however rows are dealt.
    """
    cells = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("int").alias("bin")) for n, c in bins.items()])).alias("x"))
    counts = cells.groupBy(*keys, "x.name", "x.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "name")
    counts = counts.select(*keys, "name", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    least = lambda n, q: F.min(F.when((F.col("name") == n) & (F.col("upto") >= F.col("all") * q), F.col("bin")))
    return counts.groupBy(*keys).agg(*[F.array(*[least(n, q) for q in shares]).alias(f"q_{n}") for n in bins])


def _distance_bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * DISTANCE_BINS)


def _distance_of(bin_: Column) -> Column:
    """The upper edge of a bin."""
    return F.pow(F.lit(2.0), (bin_ + 1) / F.lit(float(DISTANCE_BINS)))


def _distances(rows: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance from their group's centre."""
    d = len(FEATURES)
    away = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i + 1):
            total = total + F.lit(1.0 if i == j else 2.0) * away[i] * away[j] * F.get("inverse", i * d + j)
    return rows.join(factors, _match(rows, factors, keys), "left").select(*rows.columns, total.alias("d2"))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"g_{k}" for k in keys})


def _starts(pool: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of each of the three starts with d2, the distance by which the first core is chosen."""
    bins = {f: F.floor(F.col(f) * FEATURE_BINS) for f in FEATURES}
    mid = _named(durable(_quantiles(pool, groups, bins, [0.25, 0.5, 0.75]), "medians"), groups)
    every = _named(durable(_factors(_moments(pool, groups), groups), "factors"), groups)
    rows = _distances(pool, every, groups).withColumnRenamed("d2", "by_all")
    rows = rows.join(mid, _match(rows, mid, groups), "left")
    parts = []
    for f in FEATURES:
        spread = (F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / F.lit(FEATURE_BINS * 1.349)
        centre = (F.col(f"q_{f}")[1] + 0.5) / FEATURE_BINS
        parts.append(F.pow(F.col(f) - centre, 2) / (spread * spread + RIDGE[f]))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    starts = [total, F.greatest(*parts), F.col("by_all")]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), c.alias("d2")) for i, c in enumerate(starts)])).alias("s")
    return rows.select(*groups, *FEATURES, each).select(*groups, "s.start", *FEATURES, "s.d2")


def _least_determinant(pool: DataFrame, groups: list[str]) -> DataFrame:
    """The factors of each group's core of the least determinant; columns g_<key>."""
    keys = [*groups, "start"]
    near = _starts(pool, groups)
    three = pool.select(*groups, F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("start"), *FEATURES)
    best: DataFrame | None = None
    for _ in range(STEPS):
        bound = _named(durable(_quantiles(near, keys, {"d2": _distance_bin(F.col("d2"))}, [CORE_SHARE]), "bounds"), keys)
        core = near.join(bound, _match(near, bound, keys), "left").where(F.col("d2") <= _distance_of(F.col("q_d2")[0]))
        found = durable(_factors(_moments(core.select(*keys, *FEATURES), keys), keys), "factors")
        if best is None:
            best = found
        else:
            old = _named(best.select(*keys, F.col("determinant").alias("old")), keys)
            smaller = found.join(old, _match(found, old, keys)).where(F.col("determinant") < F.col("old") - 1e-3)
            if smaller.isEmpty():
                break
            # A step that doesn't help a start leaves it as it was.
            least = found.unionByName(best).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in found.columns if c not in keys]), "determinant").alias("f"))
            best = durable(least.select(*keys, "f.*"), "factors")
        near = _distances(three, _named(best, keys), keys)
    order = F.struct("determinant", "start")
    least = best.groupBy(*groups).agg(F.min_by(F.struct(*[c for c in best.columns if c not in keys]), order).alias("f"))
    return _named(durable(least.select(*groups, "f.*"), "factors"), groups)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Base rules fail below ten words or with more than 20 % repeated words.
    Other documents are rejected if their scaled squared distance in their
    group exceeds ``cutoff``; those of groups with fewer than ``MIN_GROUP``
    such documents, too few for a scatter of their own, are judged by the
    estimate over all documents that pass the base rules.  Null keys form
    groups of their own.  Null and empty texts have no words and fail.
    Repeated rows count as often as they occur, and further columns are not
    read.  No rows give no rows.  ``distance`` is null where the base rules
    failed.
    """
    names = [f"k{i}" for i in range(len(keys))]
    stats = statistics(docs, id_col=id_col, text_col=text_col, keys=list(keys))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = durable(stats.select("*", failed.alias("base_failed"), *features()), "statistics")
    judged = stats.where("not base_failed").select(*names, *FEATURES)
    sizes = _named(durable(judged.groupBy(*names).agg(F.count("*").alias("size")), "sizes"), names)
    groups = ["rest", *[f"c{i}" for i in range(len(names))]]

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows with their group: rest 0 and their keys, or rest 1 and nulls in small groups."""
        small = F.coalesce(F.col("size"), F.lit(0)) < MIN_GROUP
        out = rows.join(sizes, _match(rows, sizes, names), "left").withColumn("rest", small.cast("int"))
        return out.select(*rows.columns, "rest", *[F.when(~small, F.col(k)).alias(f"c{i}") for i, k in enumerate(names)])

    own = grouped(judged)
    none = [F.lit(None).cast(judged.schema[k].dataType).alias(f"c{i}") for i, k in enumerate(names)]
    pool = own.where("rest = 0").select(*groups, *FEATURES)
    if not sizes.where(F.col("size") < MIN_GROUP).isEmpty():
        pool = pool.unionByName(judged.select(F.lit(1).alias("rest"), *none, *FEATURES))
    pool = durable(pool, "pool")
    factors = _least_determinant(pool, groups)
    final = _distances(pool, factors, groups)
    scale = _named(durable(_quantiles(final, groups, {"d2": _distance_bin(F.col("d2"))}, [0.5]), "scales"), groups)
    whole = _distances(grouped(stats), factors, groups)
    measured = whole.join(scale, _match(whole, scale, groups), "left")
    # The estimate of a core is too small; medians of distances put it right, but never enlarge distances.
    half = F.greatest(_distance_of(F.col("q_d2")[0]), F.lit(1e-9))
    distance = F.when(~F.col("base_failed"), F.col("d2") * F.least(F.lit(1.0), F.lit(CHI2_MEDIAN) / half))
    measured = measured.withColumn("distance", distance)
    return measured.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
