import hashlib
import math
import re
from collections import defaultdict

import pytest

from chartlake.llm import mixing

from .conftest import prose


def brute_targets(sizes):
    """Sizes by source, None last; weights 1, 2, 3 repeating; caps at three times the size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= new


def brute_mix(rows, seed="mix-1"):
    """(size, taken, first position) of each (id, text, source) row; schedules rise, stay level and fall in turn."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, r in zip(size, rows, strict=True):
        total[r[2]] += n
    targets, out = brute_targets(total), [None] * len(rows)
    names = sorted(x for x in total if x is not None) + [None] * (None in total)
    for rank, source in enumerate(names):
        own = [k for k, r in enumerate(rows) if r[2] == source]
        own.sort(key=lambda k: (hashlib.md5("|".join([seed, "" if rows[k][0] is None else str(rows[k][0])]).encode()).hexdigest(), rows[k][0] or 0, size[k]))
        target, whole, start = targets[source], math.floor(targets[source] + 0.5), 0
        w0, slope = ((0.5, 1.0), (1.0, 0.0), (1.5, -1.0))[rank % 3]
        for k in own:
            begins = [start + e * total[source] for e in range(3) if size[k] and start + e * total[source] < whole]
            share = start / target if target else 0
            time = min(1.0, 2 * share / (w0 + math.sqrt(max(0, w0 * w0 + 2 * slope * share))))
            out[k] = (size[k], sum(min(size[k], whole - b) for b in begins), time if begins else None)
            start += size[k]
    return out


def check(df):
    rows = mixing.mix(df).collect()
    size, source = defaultdict(int), {}
    for r in df.select("doc_id", "text", "source").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        size[r["source"]] += n
        source[r["doc_id"]] = r["source"]
    want = brute_targets(size)
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and len(r["positions"]) == r["epochs"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert len(rows) == df.count()
    return rows


def test_awkward(awkward):
    check(awkward)


def test_caps_and_hot_source(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_SLICE", 8)
    rows = [(i, prose(i, 5 + i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(300)] + [(1000, "one", "tiny")]
    out = check(make_docs(rows))
    positions = [r["position"] for r in out if r["position"] is not None]
    assert positions == sorted(positions)
    again = mixing.mix(make_docs(rows[::-1])).collect()
    assert {(r["doc_id"], r["taken"], r["position"]) for r in out} == {(r["doc_id"], r["taken"], r["position"]) for r in again}


def test_empty(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    assert [r["taken"] for r in mixing.mix(make_docs([(1, None, None)])).collect()] == [0]


def test_inverse_demand(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.5, 1.0), (1.0, 3.0))
    df = spark.range(101).select((F.col("id") / 100.0).alias("y"))
    rows = df.select("y", mixing.inverse_demand(F.col("y"), knots).alias("t")).collect()
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    for r in rows:
        demand, n = 0.0, 20_000
        for k in range(n):  # integrate up to t by midpoints
            t = (k + 0.5) * r["t"] / n
            w = next(wa + (wb - wa) * (t - a) / (b - a) for (a, wa), (b, wb) in zip(knots, knots[1:], strict=False) if b > a and a <= t <= b)
            demand += w * r["t"] / n
        assert demand / area == pytest.approx(r["y"], abs=1e-3)
