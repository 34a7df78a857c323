import random
from collections import Counter

import pyarrow as pa

from goldweave.operators import blocking, overlap


def test_open_blocks_leave_a_task_in_parts(monkeypatch):
    """Blocks cut anywhere by batches, one side missing in some, give each pair once, a few at a time."""
    monkeypatch.setattr(overlap, "_HELD", 5)
    rng = random.Random(4)
    rows = []
    for block in range(4):
        for left in (False, True):
            if (block, left) in ((1, True), (2, False)):
                continue
            rows += [{"id": 1000 * left + 100 * block + i, "p0": sorted(set(rng.choices("abcdef", k=rng.randint(0, 3)))), "common": [], "__l": block // 2, "__r": block % 2, "__left": left} for i in range(12)]
    kind = pa.schema([("id", pa.int64()), ("p0", pa.list_(pa.string())), ("common", pa.list_(pa.string())), ("__l", pa.int32()), ("__r", pa.int32()), ("__left", pa.bool_())])
    out = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("rough_score", pa.float64())])
    batches = [b for k in range(0, len(rows), 7) for b in pa.Table.from_pylist(rows[k : k + 7], schema=kind).to_batches()]
    made = list(overlap.all_of_blocks(iter([*batches[:2], pa.RecordBatch.from_pylist([], schema=kind), *batches[2:]]), rough=0.3, schema=out))
    found = Counter((r["l_id"], r["r_id"], round(r["rough_score"], 9)) for b in made for r in b.to_pylist())
    want = Counter()
    for a in rows:
        for b in rows:
            x, y = set(a["p0"]), set(b["p0"])
            if a["__left"] and not b["__left"] and (a["__l"], a["__r"]) == (b["__l"], b["__r"]) and x & y and len(x & y) / len(x | y) >= 0.3:
                want[a["id"], b["id"], round(len(x & y) / len(x | y), 9)] += 1
    assert want and found == want and len(made) > 4 and max(b.num_rows for b in made) < 5 + 12


def test_rows_go_into_few_open_blocks():
    """At 1.5 million rows a side each row goes into some dozens of blocks, and not into hundreds."""
    n_l, n_r = blocking._blocks(1_500_000, 1_500_000, blocking.OPEN_PAIRS)
    assert n_l + n_r <= 60 and (1_500_000 // n_l) * (1_500_000 // n_r) <= blocking.OPEN_PAIRS
