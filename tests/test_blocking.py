import random
from collections import Counter

import pytest

from goldweave.operators import blocking, cards, evaluation, graph
from goldweave.plans import profile

RECORD = "id int, title string, title_norm string, manufacturer_norm string, price_norm double, tokens array<string>, parts array<array<string>>"


def record(i, columns, block):
    parts = [sorted(set(c.split())) for c in columns]
    return (i, columns[0], columns[0], "", 1.0, sorted({t for k in block for t in parts[k]}), parts)


def jaccard(x, y):
    x, y = set(x), set(y)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def brute(left, right, cap, weights, block, rough=blocking.ROUGH, top_k=blocking.TOP_K):
    postings = Counter(t for r in right for t in r[5])
    out = set()
    for a in left:
        near = [b for b in right if any(t in b[5] and postings[t] <= cap for t in a[5])]
        if not near and len(weights) > 1:
            near = [b for b in right if not b[5] and {t for p in a[6] for t in p} & {t for p in b[6] for t in p}]
        scored = []
        for b in near:
            used = [(w, jaccard(x, y)) for w, x, y in zip(weights, a[6], b[6], strict=True) if w > 0 and (x or y)]
            s = sum(w * j for w, j in used) / sum(w for w, _ in used) if used else 0.0
            if s >= rough - 1e-12:
                scored.append((-s, b[0]))
        out |= {(a[0], i, round(-s, 9)) for s, i in sorted(scored)[:top_k]}
    return out


def got(df):
    return {(r.l_id, r.r_id, round(r.rough_score, 9)) for r in df.collect()}


@pytest.mark.parametrize(("seed", "top_k", "pairs"), [(1, 40, 1 << 22), (2, 3, 7), (3, 1, 50)])
def test_best_candidates_against_all_pairs(spark, seed, top_k, pairs, monkeypatch):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.12)), 60)}"
    make = lambda i: record(i, [" ".join(word() for _ in range(rng.randint(0, 9))), rng.choice(["acme", "acme co", "", "zed"]), str(rng.randint(1, 4))], [0, 1])
    left, right = [make(i) for i in range(60)], [make(i) for i in range(300, 420)]
    left[0] = record(0, ["", "", "2"], [0, 1])
    right[0] = record(300, ["", "", "2"], [0, 1])
    weights = [0.5, 0.3, 0.2]
    monkeypatch.setattr(blocking, "TOKEN_PAIRS", pairs)
    frames = [spark.createDataFrame(x, RECORD) for x in (left, right)]
    for cap in (30, 1000):
        want = brute(left, right, cap, weights, [0, 1], top_k=top_k)
        assert want and got(blocking.block_schema(*frames, cap=cap, weights=weights, blocking=[0, 1], top_k=top_k)) == want
    assert got(blocking.block_schema(*frames, cap=30, weights=weights, top_k=top_k)) == brute(left, right, 30, weights, [0, 1], top_k=top_k)  # no place named: no bound


def test_titles_alone_and_empty_sides(spark):
    rng = random.Random(5)
    make = lambda i: record(i, [" ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randint(0, 6)))], [0])
    left, right = [make(i) for i in range(40)], [make(i) for i in range(100, 160)]
    frames = [spark.createDataFrame(x, RECORD) for x in (left, right)]
    assert got(blocking.block_schema(*frames, cap=25, top_k=5)) == brute(left, right, 25, [1.0], [0], top_k=5)
    assert blocking.block_schema(frames[0].limit(0), frames[1], cap=25).count() == 0
    assert blocking.block_schema(frames[0], frames[1].limit(0), cap=25).count() == 0


def test_common_tokens_are_not_looked_up_where_rare_ones_decide(spark, monkeypatch):
    """Every row shares a common token with every other, and two rare ones with its partners: pairs grow with the rows, not with their square."""
    asked = []
    step = graph.settled

    def seen(df):
        out = step(df)
        if "rough_score" in df.columns:
            asked.append(out.count())
        return out

    monkeypatch.setattr(blocking, "settled", seen)
    found = {}
    for n in (100, 400):
        rows = [[record(i + k * 1000, [f"common also rare{i // 4} more{i // 4}"], [0]) for i in range(n)] for k in (0, 1)]
        frames = [spark.createDataFrame(x, RECORD) for x in rows]
        asked.clear()
        pairs = blocking.block_schema(*frames, cap=10**6, top_k=4)
        assert pairs.count() == 4 * n
        found[n] = max(asked)
    assert found[400] == 4 * found[100] == 1600
    plan = blocking.block_schema(*frames, cap=10**6, top_k=4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sweep_against_single_thresholds(spark):
    rng = random.Random(8)
    rows = [(a, b, rng.choice([0.6, 0.7, 0.72, 0.9, 0.94, 0.97]), rng.random() < 0.2) for a in range(12) for b in range(12) if rng.random() < 0.4]
    scored = spark.createDataFrame(rows, "l_id int, r_id int, confidence double, conflict boolean")
    truth = {(i, i) for i in range(14)}
    frame = spark.createDataFrame(sorted(truth), "l_id int, r_id int")
    found = {(r.rule, r.threshold, r.margin): r for r in evaluation.rule_sweep(scored, frame, [0.72, 0.6, 0.95], [0.04, 0.2]).collect()}
    assert len(found) == 3 + 3 + 6
    for (rule, t, m), r in found.items():
        if rule == "all_above":
            taken = {(x[0], x[1]) for x in rows if x[2] >= t}
        elif rule == "mutual_top_1to1":
            taken = {(x.l_id, x.r_id) for x in graph.mutual_top(scored, t).collect()}
        else:
            taken = {(x.l_id, x.r_id) for x in graph.mutual_best(scored, low=t, margin=m).collect()}
        assert (r.tp, r.predicted, r.fp, r.fn) == (len(taken & truth), len(taken), len(taken - truth), len(truth - taken)), (rule, t, m)
    empty = evaluation.rule_sweep(scored.limit(0), frame, [0.6]).collect()
    assert [(r.tp, r.fn, r.f1) for r in empty] == [(0, 14, 0.0)] * 3


def test_curves_against_ranks(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(150)]
    df = spark.createDataFrame(rows, "label int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df, "s").first()[0] == pytest.approx(auc, abs=1e-6)
    ap = 0.0
    for t in sorted(set(pos), reverse=True):
        hit = [y for y, s in rows if s >= t]
        ap += sum(hit) / len(hit) * pos.count(t) / len(pos)
    assert evaluation.average_precision(df, "s").first()[0] == pytest.approx(ap, abs=1e-6)
    ordered = sorted(s for _, s in rows)
    want = {q: ordered[int((len(rows) - 1) * q)] for q in (0.0, 0.25, 1.0)}
    assert {r.q: r.score for r in evaluation.score_quantiles(df, "s", list(want)).collect()} == want


def test_samples_have_exact_sizes(spark):
    rows = [(i, "a" if i % 3 else "b", "x") for i in range(1000)] + [(5, "c", "twice")] * 7 + [(None, None, "none"), (None, "a", "no key")]
    df = spark.createDataFrame(rows, "id int, label string, more string")
    n = Counter(r[1] for r in rows)
    shares = {"a": 0.137, "b": 0.5, "c": 0.5, "absent": 0.9}
    took = cards.stratified(df, "label", shares, "id").collect()
    assert Counter(r.label for r in took) == {k: round(n[k] * f) for k, f in shares.items() if n[k]}
    assert sorted(map(tuple, took), key=repr) == sorted(map(tuple, cards.stratified(df.repartition(7), "label", shares, "id").collect()), key=repr)
    assert {r.id for r in took} != {r.id for r in cards.stratified(df, "label", shares, "id", seed=1).collect()}
    assert cards.stratified(df, "label", {"a": 1.0}, "id").count() == n["a"] and cards.stratified(df, "label", {"a": 0.0}, "id").count() == 0
    assert cards.stratified(df.limit(0), "label", shares, "id").count() == 0


def test_plans_name_their_blocking_parts():
    plan = profile.header_plan(["id", "Beer_Name", "Brew_Factory_Name", "Style", "ABV"])
    assert profile.blocking_parts(plan) == [1, 2] and profile.master_specs(plan) == [(c, c) for c in ("Beer_Name", "Brew_Factory_Name", "Style", "ABV")]
    assert blocking.posting_cap(1000) == 80


def test_blocks_of_both_sides_against_all_pairs(spark, monkeypatch):
    """Several blocks a side, a token in most rows, rows of more than 255 tokens, ids as texts, and no row for a pair that shares a common token only."""
    rng = random.Random(11)
    word = lambda: f"w{min(int(rng.expovariate(0.1)), 50)}"
    make = lambda i: record(i, [" ".join(["common"] + [word() for _ in range(rng.randint(0, 8))]), rng.choice(["acme", "zed"])], [0, 1])
    left, right = [make(i) for i in range(90)], [make(i) for i in range(1000, 1130)]
    left[3] = record(3, [" ".join(f"x{k}" for k in range(300)), "acme"], [0, 1])
    right[5] = record(1005, [" ".join(f"x{k}" for k in range(20, 310)), "zed"], [0, 1])
    monkeypatch.setattr(blocking, "TOKEN_PAIRS", 1500)
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 25)
    assert blocking._blocks(90, 130) == (5, 2) and blocking._blocks(0, 0) == (1, 1)
    step = blocking.best_of_block

    def seen(a, b, **kw):
        out = step(a, b, **kw)
        assert a.num_rows < 90 and b.num_rows < 130 and out.num_rows <= kw["top_k"] * a.num_rows, "a task holds a side whole, or returns more than its best"
        return out

    monkeypatch.setattr(blocking, "best_of_block", seen)
    frames = [spark.createDataFrame(x, RECORD) for x in (left, right)]
    want = brute(left, right, 60, [0.7, 0.3], [0, 1], top_k=4)
    assert any(a == 3 and b == 1005 for a, b, _ in want)
    assert got(blocking.block_schema(*frames, cap=60, weights=[0.7, 0.3], blocking=[0, 1], top_k=4)) == want
    texts = [f.withColumn("id", f.id.cast("string")) for f in frames]
    found = {(int(a), int(b), s) for a, b, s in got(blocking.block_schema(*texts, cap=60, weights=[0.7, 0.3], blocking=[0, 1], top_k=4))}
    assert found == want


def _lists(rng, ids, size):
    import pyarrow as pa

    rows = [[f"w{k}" for k in sorted({min(int(rng.expovariate(0.05)), 90) for _ in range(rng.randint(0, size))})] for _ in ids]
    return pa.table({"id": pa.array(ids, pa.int64()), "p0": pa.array(rows, pa.list_(pa.string()))})


@pytest.mark.parametrize(("rough", "top_k"), [(0.18, 40), (0.5, 3), (0.0, 7), (0.18, None)])
def test_blocks_of_titles_name_their_common_tokens_only(rough, top_k):
    """A block of titles is told which tokens are no keys, instead of a second list of tokens for each row; sizes and counts alone decide."""
    import pyarrow as pa

    from goldweave.operators.overlap import best_of_block

    rng = random.Random(7)
    left, right = _lists(rng, list(range(70)), 12), _lists(rng, list(range(1000, 1511)), 14)
    common = {"w0", "w1", "w5"}
    right = right.append_column("common", pa.array([[t for t in row if t in common] for row in right["p0"].to_pylist()], pa.list_(pa.string())))
    schema = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("s", pa.float64())])
    found = best_of_block(left, right, weights=[1.0], rough=rough, top_k=top_k, schema=schema)
    want = set()
    for a in left.to_pylist():
        x = set(a["p0"])
        scored = [(-jaccard(x, y["p0"]), y["id"]) for y in right.to_pylist() if (x & set(y["p0"])) - common and jaccard(x, y["p0"]) >= rough]
        want |= {(a["id"], i, -s) for s, i in sorted(scored)[:top_k]}
    assert want and set(zip(*(c.to_pylist() for c in found.columns), strict=True)) == want


def test_candidates_beyond_the_bound_of_a_share_are_left_out(monkeypatch):
    """Rows of many candidates: the bound changes no result, with ties at the last place."""
    import pyarrow as pa

    from goldweave.operators import overlap

    rng = random.Random(9)
    make = lambda ids: _lists(rng, ids, 9).append_column("p1", pa.array([[rng.choice("abc")] if rng.random() < 0.8 else [] for _ in ids], pa.list_(pa.string())))
    left, right = make(list(range(50))), make(list(range(1000, 1400)))
    both = lambda t: t.append_column("keys", pa.array([sorted(set(a + b)) for a, b in zip(t["p0"].to_pylist(), t["p1"].to_pylist(), strict=True)], pa.list_(pa.string())))
    schema = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("s", pa.float64())])
    run = lambda: overlap.best_of_block(both(left), both(right), weights=[0.7, 0.3], rough=0.1, top_k=5, schema=schema)
    want = run()
    monkeypatch.setattr(overlap, "_MANY", 20)
    monkeypatch.setattr(overlap, "_SHARE", 3)
    assert run().equals(want) and want.num_rows > 200


def test_a_block_counts_equal_titles_once(monkeypatch):
    """Left rows of the same tokens are counted once, and so are the common tokens that rows have alike."""
    import pyarrow as pa

    from goldweave.operators import overlap

    lists = pa.list_(pa.string())
    titles = [["the", "of", "red"], ["of", "blue", "the"], ["red", "of", "the"], ["the"], ["green"], ["the", "of", "red"]]
    others = [["the", "of", "red", "x"], ["the", "of"], ["blue", "of"], ["green", "y"], ["red"]]
    left = pa.table({"id": pa.array(range(6), pa.int64()), "p0": pa.array(titles, lists)})
    right = pa.table({"id": pa.array(range(5), pa.int64()), "p0": pa.array(others, lists), "common": pa.array([[w for w in x if w in ("the", "of")] for x in others], lists)})
    schema = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("rough_score", pa.float64())])
    added, add = [], overlap._Tokens.add
    monkeypatch.setattr(overlap._Tokens, "add", lambda self, codes, to: (added.extend(codes), add(self, codes, to))[1])
    got = overlap.best_of_block(left, right, weights=[1.0], rough=0.1, top_k=5, schema=schema).to_pylist()
    want = []
    for i, a in enumerate(titles):
        for j, b in enumerate(others):
            both = set(a) & set(b)
            if both - {"the", "of"}:
                want.append({"l_id": i, "r_id": j, "rough_score": len(both) / len(set(a) | set(b))})
    assert sorted(got, key=lambda x: (x["l_id"], x["r_id"])) == want
    assert len(added) == 6  # "the of" and "the" once, and one key for each of three titles


@pytest.mark.parametrize(("rough", "top_k", "size"), [(0.18, 40, 12), (0.18, 3, 12), (0.5, 3, 6), (0.05, 7, 40), (0.18, None, 14), (0.18, 1, 2)])
def test_titles_that_meet_by_tokens_against_all_pairs(monkeypatch, rough, top_k, size):
    """Copies on both sides, ties, one-token and long titles, and tokens that are no keys; ids are not in the order of rows."""
    import pyarrow as pa

    from goldweave.operators import overlap

    monkeypatch.setattr(overlap, "MANY_TITLES", 1)
    monkeypatch.setattr(overlap, "_HELD", 64)
    rng = random.Random(size)
    left, right = _lists(rng, list(range(150)), size), _lists(rng, rng.sample(range(1000, 3000), 500), size)
    left = pa.concat_tables([left, left.slice(0, 40).set_column(0, "id", pa.array(range(200, 240), pa.int64()))])
    right = pa.concat_tables([right, right.slice(0, 200).set_column(0, "id", pa.array(range(500, 700), pa.int64()))])
    common = {"w0", "w1", "w5"}
    right = right.append_column("common", pa.array([[t for t in row if t in common] for row in right["p0"].to_pylist()], pa.list_(pa.string())))
    schema = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("s", pa.float64())])
    found = overlap.best_of_block(left, right, weights=[1.0], rough=rough, top_k=top_k, schema=schema)
    want = set()
    for a in left.to_pylist():
        x = set(a["p0"])
        scored = [(-jaccard(x, y["p0"]), y["id"]) for y in right.to_pylist() if (x & set(y["p0"])) - common and jaccard(x, y["p0"]) >= rough]
        want |= {(a["id"], i, -s) for s, i in sorted(scored)[:top_k]}
    assert want and found.num_rows == len(want) and set(zip(*(c.to_pylist() for c in found.columns), strict=True)) == want
    assert overlap.best_of_block(left, right.slice(0, 0), weights=[1.0], rough=rough, top_k=top_k, schema=schema).num_rows == 0


def test_few_pairs_of_titles_are_compared(monkeypatch):
    """Nearly all rows share tokens: few pairs are compared, and with twice the rows less than twice as many."""
    import pyarrow as pa

    from goldweave.operators import overlap

    monkeypatch.setattr(overlap, "MANY_TITLES", 1)
    step, asked = overlap._Titles._compared, []
    monkeypatch.setattr(overlap._Titles, "_compared", lambda self, x, y, rough: (asked.append(len(x)), step(self, x, y, rough))[1])
    schema = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("s", pa.float64())])
    word = lambda rng: f"w{min(int(rng.paretovariate(0.5)), 3000)}"
    n, found = 8000, {}
    for rows in (n, 2 * n):
        rng = random.Random(3)
        make = lambda ids: pa.table({"id": pa.array(ids, pa.int64()), "p0": pa.array([sorted({word(rng) for _ in range(12)}) for _ in ids], pa.list_(pa.string()))})
        left, right = make(list(range(300))), make(list(range(10**6, 10**6 + rows)))
        right = right.append_column("common", pa.array([[]] * rows, pa.list_(pa.string())))
        asked.clear()
        assert overlap.best_of_block(left, right, weights=[1.0], rough=0.18, top_k=5, schema=schema).num_rows > 1000
        found[rows] = sum(asked)
    assert 0 < found[2 * n] < 1.9 * found[n] and found[n] < 0.05 * 300 * n, found
