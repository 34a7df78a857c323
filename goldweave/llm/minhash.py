"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One scan turns each text into its set of word shingles, a key of the whole
   set, band values of ``bands * rows`` MinHash samples, and an odd sketch: a
   bitmap in which every sample flips one bit.  The population count of the
   XOR of two sketches estimates how many samples differ.
2. Texts with one set collapse to their smallest id, however many there are.
3. Representatives that share a band value are candidates.  Buckets with the
   same members count as one.  First each representative is compared with the
   centre (smallest id) with which it shares most bands, if their sizes and
   odd sketches let the pair pass; this joins large groups without forming
   their pairs, and texts are fetched for pairs that passed only.  Then buckets that still hold several
   components are dealt into blocks of bounded size.  A first pass over blocks
   reads odd sketches only and tells which members have a partner in another
   component that can't be ruled out; a second one reads the texts of these.
4. Every link is confirmed on the full shingle sets, which are made from the
   texts where they are compared: texts are smaller than their sets.  Blocks
   return no more links than join their components, so no pairs are listed.

With 24 bands of 4 rows a pair of similarity 0.8 shares no band with
probability (1 - 0.8**4)**24 = 3e-6, and the sketch bound lies more than five
standard deviations beyond the expected count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import bloom
from goldweave.llm.components import connected_components
from goldweave.llm.durable import bound_batches, durable, forget
from goldweave.llm.skew import with_hot
from goldweave.llm.words import U, constants, hash_texts, shingles, splitmix

BANDS, ROWS, SKETCH_BITS, BLOCK = 24, 4, 256, 1024
_SKETCHED = "doc_id long, n_shingles long, key binary, bands array<long>, sketch binary"
_MEMBER = ["rep", "label", "n_shingles", "side", "own", "sketch"]


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity bitmap of the (index, value) samples."""
    spot = splitmix(samples ^ constants(len(samples), 31)) % U(bits)
    parity = np.bincount(spot.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def sketch_limit(threshold: float, samples: int, bits: int = SKETCH_BITS, sigmas: float = 5.5) -> int:
    """Largest XOR count at which a pair of similarity ``threshold`` has to be confirmed."""
    changed = 2 * samples * (1 - threshold)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** changed)
    slope = (1 - 2 / bits) ** changed
    spread = np.sqrt((2 * slope) ** 2 * samples * threshold * (1 - threshold) + bits / 4 * (1 - slope**2))
    return int(min(bits, np.ceil(mean + sigmas * spread)))


def _set_key(own: np.ndarray) -> bytes | None:
    """A key of a set of shingles; none for the empty set."""
    if not len(own):
        return None
    return np.array([splitmix(own).sum(), splitmix(own ^ U(0x5851F42D4C957F2D)).sum(), len(own)], dtype=U).tobytes()


def _sketcher(k: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, shift = constants(bands * rows, 5)[:, None], constants(bands * rows, 7)[:, None]
        weight = constants(rows, 13)[None, :]
        tag = splitmix(np.arange(bands, dtype=U))
        for batch in batches:
            ids, count, keys, band, sketches = batch.column(0), [], [], [], []
            for words in hash_texts(batch.column(1).to_pylist()):
                own = np.unique(shingles(words, k))
                count.append(len(own))
                keys.append(_set_key(own))
                if not len(own):
                    band.append(None), sketches.append(None)
                    continue
                low = np.full(bands * rows, ~U(0), dtype=U)
                for at in range(0, len(own), 4096):
                    np.minimum(low, (own[None, at : at + 4096] * scale + shift).min(axis=1), out=low)
                own_bands = splitmix((low.reshape(bands, rows) * weight).sum(axis=1)) ^ tag
                band.append(own_bands.view(np.int64))
                sketches.append(odd_sketch(low))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "key", "bands", "sketch"],
            )

    return sketch


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets without repeats reach the similarity."""
    small, large = min(len(p), len(q)), max(len(p), len(q))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _placed(bits: object):
    """(bucket, rep) of the bands that may be in the filter."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            flat, width = bands.flatten().to_numpy(), np.diff(bands.offsets.to_numpy())
            may = bloom.may_hold(bits.value, flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[may]), pa.array(np.repeat(batch.column(0).to_numpy(), width)[may])], ["bucket", "rep"])

    return placed


def _buckets(reps: DataFrame, total: int) -> DataFrame:
    """(bucket, centre, n, weight) of buckets of two representatives or more.

    Buckets with the same members, which are those of one group of near copies
    for the most part, count as one of that ``weight``.  Members are told by
    two sums over hashes of their ids.
    """
    placed = reps.select("rep", F.explode("bands").alias("bucket"))
    mark = lambda seed: F.sum(F.hash("rep", F.lit(seed)))
    every = placed.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    return every.groupBy("centre", "n", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("weight")).select("bucket", "centre", "n", "weight")


def _within(limit: int, percent: int):
    """(a, b, copies) of pairs whose sizes and odd sketches don't rule the similarity out."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            one, two = (batch.column(n).to_numpy() for n in (3, 4))
            left, right = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=U).reshape(len(batch), -1) for n in (5, 6))
            far = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            may = pa.array((100 * np.minimum(one, two) >= percent * np.maximum(one, two)) & (far <= limit))
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(may) for n in range(3)], ["a", "b", "copies"])

    return within


def _star_links(texts: DataFrame, stars: DataFrame, reps: DataFrame, k: int, percent: int, limit: int) -> DataFrame:
    """Those of ``stars(a, b)``, each ``b`` with one centre ``a`` of a smaller id, whose full sets are similar enough.

    Sizes and sketches meet first, and only texts of pairs that they let pass
    go to their centre, once.  A centre of many partners is copied for each
    block of them, so no task holds more than a block.
    """
    stars = durable(stars, "votes")
    own = reps.select("rep", "n_shingles", "sketch")
    degree = stars.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("copies"))
    degree = durable(degree.join(own.toDF("a", "of_a", "sketch_a").hint("merge"), "a"), "degree")
    there = stars.join(own.toDF("b", "of_b", "sketch_b").hint("merge"), "b")
    both = with_hot(there, degree, "a", stars.count(), BLOCK).select("a", "b", "copies", "of_a", "of_b", "sketch_a", "sketch_b")
    likely = both.mapInArrow(_within(limit, percent), "a long, b long, copies int")
    centres = degree.select(F.col("a").alias("doc_id"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    members = likely.select(F.col("b").alias("doc_id"), F.col("a").alias("centre"), F.expr("cast(pmod(xxhash64(b), copies) as int)").alias("salt"))
    placed = durable(centres.union(members), "stars")
    rows = bloom.rows_of(texts, placed.select("doc_id")).join(placed.hint("merge"), "doc_id").select("centre", "salt", "doc_id", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            a, b = [], []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for (centre, salt, doc), words in zip(keys, hash_texts(batch.column(3).to_pylist()), strict=True):
                found = np.unique(shingles(words, k))
                if (centre, salt) != at:
                    at, own = (centre, salt), []
                if doc == centre:
                    if not any(np.array_equal(x, found) for x in own):
                        own.append(found)
                elif any(_similar(x, found, percent) for x in own):
                    a.append(centre), b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "doc_id")
    links = durable(together.mapInArrow(confirm, "a long, b long"), "links")
    forget(placed), forget(stars), forget(degree)
    return links


def _partners(table: pa.Table, limit: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other components that may be similar to it) of one group.

    A group of kind 1 holds a left and a right block and pairs rows across the
    two; kind 0 holds one left block, or two, and pairs them likewise.
    """
    ids, label, size = (table[c].to_numpy() for c in ("rep", "label", "n_shingles"))
    part = table["side" if table["kind"][0].as_py() else "own"].to_numpy()
    alone = part.min() == part.max()
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=U).reshape(len(ids), -1)
    for i in range(len(ids)) if alone else np.flatnonzero(part == part.min()):
        other = (label != label[i]) & (ids > ids[i] if alone else part != part[i])
        at = np.flatnonzero(other & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        far = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        at, far = at[far <= limit], far[far <= limit]
        if len(at):
            yield i, at[np.argsort(far, kind="stable")]


def _active_members(limit: int, percent: int):
    def active(table: pa.Table) -> pa.Table:
        use = np.zeros(len(table), dtype=bool)
        for i, at in _partners(table, limit, percent):
            use[i] = True
            use[at] = True
        return table.select(["bucket", "rep"]).filter(pa.array(use))

    return active


def _block_links(k: int, limit: int, percent: int):
    """Confirmed links of one group, at most one fewer than it has components."""

    def links(table: pa.Table) -> pa.Table:
        ids, label = table["rep"].to_pylist(), table["label"].to_pylist()
        sets = [np.unique(shingles(w, k)) for w in hash_texts(table["text"].to_pylist())]
        root = {x: x for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for i, at in _partners(table, limit, percent):
            for j in at.tolist():
                x, y = find(label[i]), find(label[j])
                if x != y and _similar(sets[i], sets[j], percent):
                    root[x] = y
                    a.append(min(ids[i], ids[j])), b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _dealt(members: DataFrame, labels: DataFrame, reps: DataFrame, total: int, extra: DataFrame | None = None) -> DataFrame:
    """Members of buckets with several components, dealt into groups (bucket, i, j, kind) of two blocks.

    In each bucket the largest component is the right side and all others are
    the left side.  Both are dealt into blocks; a group holds one left block
    with one right block, or two left blocks.
    """
    own = labels.withColumnRenamed("node", "rep").hint("merge")
    marked = members.join(own, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("label"))
    parts = marked.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    split = split.select(
        "bucket", "n", F.col("top.label").alias("major"),
        F.ceil(F.col("top.k") / F.lit(BLOCK)).cast("int").alias("right_blocks"),
        F.ceil((F.col("n") - F.col("top.k")) / F.lit(BLOCK)).cast("int").alias("left_blocks"),
    )
    rows = with_hot(marked, split, "bucket", total, BLOCK).join(reps.select("rep", "n_shingles", "sketch").hint("merge"), "rep")
    names = [*_MEMBER]
    if extra is not None:
        rows, names = rows.join(extra.hint("merge"), "rep"), [*names, "text"]
    rows = rows.withColumn("side", (F.col("label") == F.col("major")).cast("int"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(rep), if(side = 1, right_blocks, left_blocks)) as int)"))
    groups = F.when(
        F.col("side") == 1, F.expr("transform(sequence(0, left_blocks - 1), x -> struct(x as i, own as j, 1 as kind))")
    ).otherwise(
        F.concat(
            F.expr("transform(sequence(0, right_blocks - 1), x -> struct(own as i, x as j, 1 as kind))"),
            F.expr("transform(sequence(0, left_blocks - 1), x -> struct(least(own, x) as i, greatest(own, x) as j, 0 as kind))"),
        )
    )
    dealt = rows.select("bucket", F.explode(groups).alias("g"), *names)
    return dealt.select("bucket", "g.i", "g.j", "g.kind", *names)


def _cross_component_links(members: DataFrame, texts: DataFrame, reps: DataFrame, labels: DataFrame, total: int, k: int, limit: int, percent: int) -> DataFrame:
    """Links that join components which share buckets."""
    groups = ["bucket", "i", "j", "kind"]
    found = _dealt(members, labels, reps, total).groupBy(*groups).applyInArrow(_active_members(limit, percent), "bucket long, rep long")
    active = durable(found.distinct(), "active")
    ids = active.select(F.col("rep").alias("doc_id")).distinct()
    own = bloom.rows_of(texts, ids).join(ids.hint("merge"), "doc_id").withColumnRenamed("doc_id", "rep")
    links = durable(_dealt(active, labels, reps, total, own).groupBy(*groups).applyInArrow(_block_links(k, limit, percent), "a long, b long").distinct(), "links")
    forget(active)
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, key) of each row, and (key, rep, component) of each class of equal sets."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = durable(texts.mapInArrow(_sketcher(k, bands, rows), _SKETCHED), "sketches")
    members = sketched.where("key is not null and doc_id is not null")
    classes = durable(members.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    same = (F.col("key") == F.col("own_key")) & (F.col("doc_id") == F.col("rep"))
    # Rows that repeat an id and a set are equal here, and meet before they are shuffled.
    reps = members.dropDuplicates(["key", "doc_id"]).join(classes.withColumnRenamed("key", "own_key").hint("merge"), same, "left_semi")
    reps = durable(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), "reps")
    total = reps.count() * bands
    buckets = durable(_buckets(reps, total), "buckets")
    bits = spark.sparkContext.broadcast(bloom.build(buckets.select("bucket"), buckets.count()))
    placed = reps.select("rep", "bands").mapInArrow(_placed(bits), "bucket long, rep long")
    shared = durable(with_hot(placed, buckets, "bucket", total, BLOCK).select("bucket", "rep", "centre", "weight"), "shared")
    forget(buckets)
    votes = shared.where("rep <> centre").groupBy("rep", "centre").agg(F.sum("weight").alias("n"))
    best = votes.groupBy("rep").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("best"))
    limit = sketch_limit(percent / 100, bands * rows)
    first = _star_links(texts, best.select((-F.col("best.c")).alias("a"), F.col("rep").alias("b")), reps, k, percent, limit)
    labels = connected_components(first)
    rest = _cross_component_links(shared.select("bucket", "rep"), texts, reps, labels, total, k, limit, percent)
    forget(reps), forget(shared)
    if not rest.isEmpty():
        labels = connected_components(first.union(rest))
    forget(first), forget(rest)
    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component_id"))
    return sketched.select("doc_id", "n_shingles", "key"), named


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``docs`` to one row each: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets
    of distinct ``k``-word shingles (the whole sequence as one shingle where
    there are fewer words).  ``component_id`` is the smallest id reachable.

    Null and empty texts, and those of white space only, have no shingles and
    link with nothing.  Rows with a null id are never linked and have a null
    component; ``kept`` is true.  Rows that repeat an id count as one
    document, which is linked where any of its texts is.  Very long texts are
    taken whole.  Columns other than the id and text, whatever their names,
    are not read.  No rows give no rows.
    """
    found, named = _classes(docs, id_col, text_col, k, percent, bands, rows)
    found = found.join(named.select("key", "component_id"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _keyed(k: int, at: int):
    """Rows of a struct and a text to the struct and the key of the text's set."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_set_key(np.unique(shingles(w, k))) for w in hash_texts(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["row", "key"])

    return keyed


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which each group of near duplicates keeps its smallest id.

    Columns stay as they are, and rows with a null id stay.  Rows that repeat
    an id with one set of shingles are one document, of which the least row by
    all columns that can be sorted stays.  An id with several sets can't name
    one document: of its rows one for each set stays, so that no text is lost.
    """
    spark = docs.sparkSession
    found, named = _classes(docs, id_col, text_col, k, percent, BANDS, ROWS)
    rows = found.where("doc_id is not null").join(named.select("key", "component_id"), "key", "left")
    sets = F.xxhash64(F.coalesce("key", F.lit(b"")))
    by_id = rows.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("times"), F.min(sets).alias("low"), F.max(sets).alias("high"))
    copy = F.coalesce(F.col("component") < F.col("doc_id"), F.lit(False))
    by_id = durable(by_id.select("doc_id", copy, F.col("times") > 1, F.col("low") < F.col("high")).toDF("doc_id", "copy", "twice", "several"), "ids")
    state = by_id.select("doc_id", F.expr("copy and not several").alias("gone"), F.expr("twice and (several or not copy)").alias("again"))
    # Ids that go are a share of the input, so they outgrow a broadcast; a join with them would shuffle every text.
    own = F.col(f"`{id_col}`").cast("long")
    left = bloom.rows_without(docs, own, state.where("gone or again").select("doc_id"), state.where("not (gone or again)").select("doc_id"))
    twice = state.where("again").select("doc_id")
    if twice.isEmpty():
        forget(by_id)
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = bloom.rows_in(docs, own, twice).select(row, F.col(f"`{text_col}`").alias("text"))
    kind = again.schema["row"].dataType.simpleString()
    keyed = again.mapInArrow(_keyed(k, 1), f"row {kind}, key binary")
    order = F.struct(*[F.col(f"row.`{f.name}`") for f in docs.schema if f.dataType.simpleString().split("<")[0] not in ("map", "variant")])
    least = keyed.groupBy(F.col(f"row.`{id_col}`").alias("__own_id"), "key").agg(F.min_by("row", order).alias("row"))
    one = least.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return left.unionByName(one)
