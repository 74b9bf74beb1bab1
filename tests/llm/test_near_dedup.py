import random

import numpy as np
import pytest

from chartlake.llm import near_dedup
from chartlake.llm.common import merged_labels

from .conftest import prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, low = [(i, shingles(t)) for i, t in rows], {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    for k, (i, _) in enumerate(sets):
        r = find(k)
        low[r] = min((v for v in (low.get(r), i) if v is not None), default=None)
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets) if i is not None)


def brute_kept(rows):
    """By row whether it stays: its id is the smallest of its component, or it has none."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [i is None or low[find(k)] == i or not sets[k] for k, (i, _) in enumerate(rows)]


def run(df):
    rows = near_dedup.near_duplicates(df).collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["component_id"] or r["n_shingles"] == 0)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None)


def test_awkward(awkward):
    assert run(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_ids_that_repeat_or_lack(make_docs):
    """Texts are nodes: an id's other text is judged apart, and a text without id links its neighbours."""
    words = prose(31, 200).split()
    step = [" ".join(f"new{k}" if k < 8 * n else w for k, w in enumerate(words)) for n in range(6)]
    rows = [(5, step[0], "s"), (None, step[2], "s"), (6, step[4], "s"), (6, prose(32, 50), "s"), (3, prose(33, 60), "s"), (6, prose(32, 50), "s"), (None, prose(34, 30), "s"), (None, prose(34, 30), "s")]
    assert brute([r[:2] for r in rows]) == run(make_docs(rows)) and (6, 196, 5) in run(make_docs(rows))
    left = near_dedup.drop_near_duplicates(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted((i or 0, t) for i, t, _ in rows if t != step[4])


def test_families_and_chains(make_docs):
    """A family with many edits holds pairs above and below the limit, and chains that only link in steps."""
    rng, rows = random.Random(5), []
    for f in range(6):
        words = prose(f, 150).split()
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "s"))
        for _ in range(10):
            words = words[8:] + [f"more{rng.randrange(10**6)}" for _ in range(8)]
            rows.append((len(rows), " ".join(words), "s"))
    rng.shuffle(rows)
    assert run(make_docs(rows)) == brute([(i, t) for i, t, _ in rows])


def test_large_sets_use_samples(make_docs):
    rows, rng = [], random.Random(9)
    for f in range(4):
        words = prose(100 + f, 3000, 50_000).split()
        for edits in (0, 40, 80, 120, 300):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "s"))
        rows.append((len(rows), " ".join(words[: 3000 * 4 // 5]), "s"))
    assert run(make_docs(rows)) == brute([(i, t) for i, t, _ in rows])


def family(rng, words, copies, edits):
    for _ in range(copies):
        copy = list(words)
        for _ in range(edits if isinstance(edits, int) else rng.randrange(*edits)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        yield " ".join(copy)


def join_rows(spark, since):
    """The most rows that a join of a query after number `since` made, and the number of the last query."""
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    listed = store.executionsList().iterator()
    while listed.hasNext():
        k = listed.next().executionId()
        if k <= since:
            continue
        last, values, nodes = max(last, k), store.executionMetrics(k), store.planGraph(k).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last


def test_alike_texts_are_not_joined_pair_by_pair(spark, make_docs, monkeypatch):
    """Texts at similarity 0.7 fill buckets and pass the sketches without being links; joins make rows by texts, not by pairs."""
    monkeypatch.setattr(near_dedup, "HOT", 16, raising=False)
    rows = [(i, t, "s") for i, t in enumerate(family(random.Random(2), prose(50, 3000, 50_000).split(), 44, 58))]
    docs, since = make_docs(rows), join_rows(spark, -1)[1]
    found = run(docs)
    most, last = join_rows(spark, since)
    assert found == brute([r[:2] for r in rows]) and last > since
    assert 0 < most <= 4 * near_dedup.BANDS * len(rows)


def test_large_buckets_by_blocks(make_docs, monkeypatch):
    """Pairs above and below the limit and chains, with blocks of a few texts and few partners in a round."""
    for name, value in (("HOT", 2), ("BLOCK", 7), ("PARTNERS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    rng, rows = random.Random(6), []
    for f in range(3):
        words = prose(60 + f, 150).split()
        rows += family(rng, words, 30, (0, 9))
        for _ in range(6):
            words = words[8:] + [f"more{rng.randrange(10**6)}" for _ in range(8)]
            rows.append(" ".join(words))
    rng.shuffle(rows)
    assert run(make_docs([(i, t, "s") for i, t in enumerate(rows)])) == brute(list(enumerate(rows)))


def test_closest_returns_each_pair_once_and_in_order():
    """Against all pairs: near, of other components, beyond the mark, in the first band that both have."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(255, 301))], rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(200)]
    sketches, sizes = np.array([near_dedup.odd_sketch(s) for s in sets]), np.array([len(s) for s in sets])
    bands, labels = rng.integers(0, 3, (200, near_dedup.BANDS)), rng.integers(0, 20, 200)
    bands[:, 2] = 7
    columns = {"node": np.arange(200), "label": labels, "n": sizes, "band": np.full(200, 7)}
    columns = {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"bands": pa.array(bands.tolist(), pa.list_(pa.int64())), "sketch": pa.array(sketches.view(np.int64).tolist(), pa.list_(pa.int64()))}
    marks = {"mark": pa.array([0.05] * 200), "mark_y": pa.array([90] * 200)}
    flips = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2)
    d, want = flips / (sizes[:, None] + sizes[None]), []
    near = flips <= near_dedup.flip_limits(sizes[:, None], sizes[None], 75)
    first = ~(bands[:, None, :2] == bands[None, :, :2]).any(axis=2)
    for x in range(200):
        seen = sorted((d[x, y], y) for y in range(200) if near[x, y] and first[x, y] and labels[x] != labels[y])
        want += [(x, y, e) for e, y in [s for s in seen if s > (0.05, 90)][:3]]
    found = near_dedup.closest(75, 3)(pa.table(columns | marks), pa.table(columns))
    assert want and [(r["x"], r["y"], r["d"]) for r in found.to_pylist()] == want
    assert near_dedup.closest(75, 3)(pa.table(columns | marks), pa.table(columns).slice(0, 0)).num_rows == 0


def test_limits_of_arrays_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    n, m = rng.integers(1, 5000, 200), rng.integers(1, 5000, 200)
    df = spark.createDataFrame([*zip(n.tolist(), m.tolist())], "n long, m long")
    wanted = [r[0] for r in df.select(near_dedup.most_flips(F.col("n"), F.col("m"), 75)).collect()]
    assert np.allclose(near_dedup.flip_limits(n, m, 75), wanted)


def test_empty(make_docs):
    assert run(make_docs([])) == []
    kept = near_dedup.drop_near_duplicates(make_docs([(1, None, "a"), (2, None, "a"), (4, "a b c", "a"), (3, "A b\tc", "a")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert kept.columns == make_docs([]).columns


def test_sketch_bound_loses_no_small_pair(spark):
    """For whole sets the XOR count is at most the difference, which the limit never undercuts."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    cases = []
    for _ in range(300):
        n = int(rng.integers(5, 900))
        union = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut = len(union) // 4
        a, b = union[: len(union) - cut // 2], union[cut - cut // 2 :]
        flips = int(np.bitwise_count(near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).sum())
        cases.append((len(a), len(b), flips))
    df = spark.createDataFrame(cases, "n long, m long, flips long")
    assert df.where(F.col("flips") > near_dedup.most_flips(F.col("n"), F.col("m"), 75)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_merged_labels(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(150, 199)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    found = {r["label"]: r["root"] for r in merged_labels(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: find(x) for pair in links for x in pair if find(x) != x}
