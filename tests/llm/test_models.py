"""LM scoring, toxicity and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartlake.llm import decontam, line_dedup, near_dedup, pst, queries, toxicity
from chartlake.llm.common import crc_mod, ranked

from .conftest import prose


def test_keys_that_differ_in_low_bits_alone_are_ordered():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = (rng.integers(0, 40, n).astype(np.uint64) << np.uint64(50)) + rng.integers(0, 60, n).astype(np.uint64)
        order, ordered = pst._key_order(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and ordered.tolist() == sorted(keys.tolist())


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, -1, 255, -256, 2**40, -(2**40)])
    assert pst._unpack_counts(pst._pack_counts(numbers)).tolist() == numbers.tolist()
    keys = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    for part in (keys, keys[:0]):
        assert pst._unpack_keys(pst._pack_keys(part)).tolist() == part.tolist()


def held_column():
    return crc_mod(F.col("doc_id"), 7) == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_scores(rows):
    """The same definition over dictionaries: counts, thresholds, tree and smoothing."""
    train = [tokens(t) for i, t in rows if not held(i)]
    counts = Counter(itertools.chain(*train))
    total, kinds = sum(counts.values()), len(counts)
    n1, n2 = (sum(n == k for n in counts.values()) for k in (1, 2))
    cut = (n1 + 1) / (n1 + 2 * n2 + 2)
    least = max(2, math.ceil(pst.MIN_PROB * total))
    frequent = sorted((w for w in counts if counts[w] >= least), key=lambda w: (-counts[w], w))
    number = {w: i for i, w in enumerate(frequent)}
    grams = Counter()
    for t in train:
        for d in range(1, pst.DEPTH + 1):
            for i in range(d, len(t)):
                part = t[i - d : i + 1]
                if all(w in number for w in part):
                    grams[tuple(number[w] for w in part)] += 1
    tree = pst.SuffixTree({g: n for g, n in grams.items() if n >= least}, {number[w]: counts[w] for w in frequent}, {number[w]: (counts[w] - cut) / total for w in frequent}) if total else None
    out = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        score = 0.0
        for k, w in enumerate(t):
            context = [number.get(x) for x in t[max(0, k - pst.DEPTH) : k]]
            while None in context:
                context = context[context.index(None) + 1 :]
            root = (counts[w] - cut) / total if counts[w] else cut * kinds / total if total else 1.0
            if w in number:
                p = tree.prob(tuple(context), number[w])
            else:
                p, state = root, tuple(context)
                for d in range(len(state)):
                    p *= tree.states[state[d:]][0] if state[d:] in tree.states else 1
            score += math.log10(p)
        out.append((i, held(i), len(t), sum(counts[w] > 0 for w in t), total, base, score))
    return out


def compare(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("chunk_bytes", [10**7, 3000])
def test_lm_equals_brute_force(make_docs, chunk_bytes):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [(i, " ".join([line, prose(i, 30, 40), line if i % 3 else "", prose(i + 900, 20, 5000)]), "s") for i in range(120)]
    got = pst.score_corpus(make_docs(rows), held_column(), chunk_bytes=chunk_bytes).collect()
    want = brute_scores([(i, t) for i, t, _ in rows])
    compare(got, want)
    assert sum(r[6] for r in want if r[1]) > sum(r[5] for r in want if r[1])  # better than the base on held-out texts


def test_lm_awkward(awkward, make_docs):
    compare(pst.score_corpus(awkward, held_column()).collect(), brute_scores([(r["doc_id"], r["text"]) for r in awkward.collect()]))
    assert pst.score_corpus(make_docs([]), held_column()).collect() == []
    only_held = next(i for i in range(100) if held(i))
    row = pst.score_corpus(make_docs([(only_held, "a b", "s")]), held_column()).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def test_distribution_sums_to_one():
    counts = {(0, 1): 30, (0, 2): 10, (1, 1): 5, (2, 0, 1): 8, (2, 0): 9}
    root = {0: 0.3, 1: 0.25, 2: 0.25}
    tree = pst.SuffixTree(counts, {0: 60, 1: 50, 2: 50}, root, gain=0.0)
    for context in ((), (0,), (2, 0)):
        left = 0.2  # the root's unknown word, scaled by what each state leaves
        for d in range(len(context)):
            left *= tree.states[context[d:]][0] if context[d:] in tree.states else 1
        assert sum(tree.prob(context, x) for x in root) + left == pytest.approx(1)


def toxic_rows(n=400):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words, bad = prose(i, 60, 800).split(), rng.random() < 0.3
        if bad:
            for w in rng.sample(["idiot", "moron", "scum", "trash"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "s")), labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, make_docs):
    rows, labels = toxic_rows()
    docs, known = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known.where(crc_mod(F.col("doc_id"), 5) != 0))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    test = [(got[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in test) / len(test) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_grams_are_code_points():
    """Features are over characters: brute force over strings, whatever the script."""
    texts = ["Ab, c!! d", "naïve  café", "東京タワー、東京", "ок\u00a0ты", "x"]
    for text in texts:
        folded = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", f" {text} ")
        folded = "".join(c.lower() if c.isascii() else c for c in folded)
        grams = {folded[i : i + n] for n in toxicity.GRAMS for i in range(len(folded) - n + 1)}
        assert len(np.unique(toxicity.gram_slots(text.encode()))) == len(grams)
    assert set(toxicity.gram_slots("東京タワー".encode())) & set(toxicity.gram_slots("の東京タワーの".encode()))


def test_log_ratios_equal_brute_force():
    seen = np.array([[3, 0, 5, 0], [0, 4, 5, 0]])
    want = [math.log((seen[1][k] + 1) / 13) - math.log((seen[0][k] + 1) / 12) for k in range(4)]
    np.testing.assert_allclose(toxicity.log_ratios(seen), want)


def test_toxicity_awkward(spark, awkward, make_docs):
    labels = spark.createDataFrame([(4, None, 1), (4, 0, 0), (7, 1, 0), (8, 1, 0), (None, 0, 1), (99, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 1"), labels.where("false")):
        rows = toxicity.score_texts(awkward, toxicity.train(awkward, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.train(make_docs([]), labels)
    assert toxicity.score_texts(make_docs([]), model).collect() == []


def test_ranked(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "x long").repartition(7)
    rows = ranked(df, [F.col("x")], "r").collect()
    assert [r["r"] for r in sorted(rows)] == list(range(200))


def test_pipeline_equals_its_operators(spark, tmp_path):
    """run() against the stages applied one by one in plain Python: the same documents, words taken and positions."""
    from .test_mixing import brute_mix
    from .test_near_dedup import brute_kept
    from .test_text_operators import brute_leaks, brute_lines, hashed

    rows, labels = toxic_rows(150)
    base = prose(5000, 90)
    near = base.replace("w1", "w2", 1)
    texts = [(i, t) for i, t, _ in rows] + [(500, base), (501, base), (502, near), (503, prose(77, 40)), (504, "a b\nc d\ne f\n" + prose(78, 30)), (505, "a b\nc d\ne f\n" + prose(79, 30)), (506, None), (507, "")]
    # without id, of one id, repeated
    texts += [(None, prose(80, 30)), (None, prose(77, 40)), (None, base.replace("w3", "w4", 1)), (508, prose(81, 30)), (508, prose(77, 40) + " tail"), (508, near + " tail"), (509, prose(82, 20)), (509, prose(82, 20))]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, prose(77, 40))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(((r["doc_id"] or 0, r["size"], r["taken"], r["position"]) for r in result.collect()), key=str)

    first = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    held = [tuple(r) for r in first.select("doc_id", "text", "source").collect()]
    assert not {i for i, _, y in labels if y} & {r[0] for r in held} and {r[0] for r in held} >= {i for i, _, y in labels if not y} and len(held) == len(texts) - sum(y for _, _, y in labels)
    lines = [(i, t, s) for (i, t), (_, old, s) in zip(brute_lines(hashed(first)), held, strict=True) if t is None or t.strip() or not (old or "").strip()]
    kept = [r for r, ok in zip(lines, brute_kept([r[:2] for r in lines]), strict=True) if ok]
    clean = [(i, t, s) for i, t, s in kept if not (lambda n, h: h and 20 * h >= n)(*brute_leaks(t, items)[:2])]
    assert {500, 506, 507, 508, 509} <= {r[0] for r in clean} and not {501, 502, 503} & {r[0] for r in clean} and [t for i, t, _ in clean if i == 508] == [prose(81, 30)]
    want = sorted(((i or 0, *x) for (i, _, _), x in zip(clean, brute_mix(clean), strict=True) if x[1]), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables give an empty mix, documents without labels and benchmark are all kept."""
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long, score double", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    some = spark.createDataFrame([(1, prose(1, 50), None, None, None, 0.5), (2, prose(2, 50), None, "a", None, None)], kinds["documents"])
    some.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}


def test_queries_are_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] and decontam and line_dedup and near_dedup


def test_op10_on_data(spark, sf):
    rows = queries.op10_near_dedup(spark, sf).collect()
    assert all(r["component_id"] <= r["doc_id"] for r in rows)


def test_lm_keeps_sequences_that_occur_twice(make_docs):
    """What is repeated among 600 000 training tokens does not depend on the number of other tokens."""
    train = [i for i in range(4000) if not held(i)][:3000]
    asked = next(i for i in range(4000) if held(i))
    other = " ".join(f"f{i}" for i in range(200))
    scores = []
    for n in (300, 3000):
        rows = [(i, "a1 a2 a3 a4" if k < 2 else other, "s") for k, i in enumerate(train[:n])]
        got = pst.score_corpus(make_docs([*rows, (asked, "a1 a2 a3 a4", "s")]), held_column()).collect()
        scores.append(next(r["score"] - r["base_score"] for r in got if r["doc_id"] == asked))
    assert scores[1] > scores[0]
