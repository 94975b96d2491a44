"""The language model's kernels against loops, and whole scores against a brute-force model with fixed seating."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import base, pitman_yor

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(lower)), None]


def threes(text):
    t = tokens(text)
    return list(zip([None, None, *t], [None, *t], t, strict=False))


def one_by_one(c, others, p, d, s, rng):
    t = 1
    for n in range(1, c):
        a = (s + d * (others + t)) * p
        t += rng.random() < a / (a + n - d * t)
    return t


@pytest.mark.parametrize(("c", "others", "p", "d", "s"), [(40, 5, 0.1, 0.5, 1.0), (12, 0, 0.9, 0.8, 3.0), (300, 50, 0.02, 0.3, 0.1), (2, 1, 0.5, 0.5, 1.0)])
def test_seating_has_the_law_of_one_customer_at_a_time(c, others, p, d, s):
    rng = np.random.default_rng(1)
    n = 6000
    got = pitman_yor.seat(np.full(n, c), np.full(n, others), np.full(n, p), d, s, rng)
    want = np.array([one_by_one(c, others, p, d, s, rng) for _ in range(n)])
    assert got.min() >= 1 and got.max() <= c
    for k in range(1, int(max(got.max(), want.max())) + 1):
        a, b = (got <= k).mean(), (want <= k).mean()
        assert abs(a - b) < 4.5 * math.sqrt(0.5 / n), k
    assert pitman_yor.seat(np.array([0, 1]), np.zeros(2), np.ones(2), d, s, rng).tolist() == [0, 1]


def test_seating_of_very_many_customers_is_quick():
    t = pitman_yor.seat(np.array([10**12]), np.array([10.0]), np.array([1e-3]), 0.5, 1.0, np.random.default_rng(0))
    assert 1 <= t[0] < 10**6


def test_digamma_and_concentration():
    np.testing.assert_allclose(pitman_yor.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-9)
    rng = np.random.default_rng(2)
    customers, tables, strength, d = [], [], 7.0, 0.4
    for _ in range(800):
        n, t = int(rng.integers(2, 200)), 1
        for i in range(1, n):
            t += rng.random() < (strength + d * t) / (strength + i)
        customers.append(n)
        tables.append(t)
    got = pitman_yor.concentration(pitman_yor.histogram(np.array(customers)), pitman_yor.histogram(np.array(tables)), d)
    assert 5.5 < got < 9.0


@pytest.mark.parametrize("sweeps", [0, 3])
def test_predictive_probabilities_sum_to_one(sweeps):
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(1, 2**63, 9).astype(np.uint64))
    seen = sorted({(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 8, (60, 3))}, key=lambda x: (x[1], x[0], x[2]))
    two, one, w = (np.array([x[k] for x in seen]) for k in range(3))
    frequent = words[[2, 5]]
    asked = [(o, k) for o in (2, 5) for k in range(9) if not ((one == o) & (w == k)).any()]
    counts = pitman_yor.Counts(words, np.arange(9), two, one, w, rng.integers(1, 30, len(w)), np.array([x[0] for x in asked]), np.array([x[1] for x in asked]))
    layout = pitman_yor.Layout(1, np.sort(frequent))
    prior = pitman_yor.Prior((0.6, 0.5, 0.4), (1.5, 0.7, 2.0), 1 / 9)
    s = pitman_yor.Seating(counts, layout)

    def answers():
        rows = list(pitman_yor.reports(0, s, layout, [(s.to_root(), s.c2[s.shared])], s.statistics()))
        t = pa.table(pitman_yor._columns(rows, pitman_yor._REPORT), pitman_yor._names(pitman_yor._REPORT))
        row = pitman_yor.merged_reports(t).to_pylist()[0]
        x = pitman_yor.Shared(row, 0)
        for i in range(min(sweeps, 1)):
            x.sweep(x.totals(2), prior, np.random.default_rng(i))
        total = x.totals(2)
        return x.root_p(prior, total[0], total[3]), x.pair_p(prior, total)[pitman_yor.unpack(row["to_pair"], np.uint32)]

    for i in range(sweeps):
        s.sweep(*answers(), prior, np.random.default_rng(i))
    root, pair = answers()
    assert root.sum() == pytest.approx(1)  # eight words that occur and the unknown one
    predict = s.predictor(root, pair, prior)
    for a in range(9):
        for b in range(9):
            assert predict(np.full(9, a), np.full(9, b), np.arange(9)).sum() == pytest.approx(1), (a, b)


def brute_force(docs, model):
    """Scores with one table for each word in each restaurant, by plain dictionaries."""
    (d1, d2, d3), (s1, s2, s3) = model.priors[1].discount, model.priors[1].strength
    c3 = Counter()
    for text, learn in docs:
        if learn:
            c3.update(threes(text))
    c2, c1 = Counter((b, w) for _, b, w in c3), Counter()
    for _, w in c2:
        c1[w] += 1
    n3, t3, n2, t2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), c in c3.items():
        n3[a, b] += c
        t3[a, b] += 1
    for (b, _), c in c2.items():
        n2[b] += c
        t2[b] += 1
    total, base_p = sum(c1.values()), 1 / (len(c1) + 1)

    def p(a, b, w):
        x = (max(0.0, c1[w] - d1) + (s1 + d1 * len(c1)) * base_p) / (s1 + total)
        x = (max(0.0, c2[b, w] - d2) + (s2 + d2 * t2[b]) * x) / (s2 + n2[b])
        return (max(0.0, c3[a, b, w] - d3) + (s3 + d3 * t3[a, b]) * x) / (s3 + n3[a, b]) if n3[a, b] else x

    return [sum(math.log10(p(*x)) for x in threes(text)) for text, _ in docs]


@pytest.mark.parametrize(("part_bytes", "share", "block"), [(12 << 20, 0.25, 2_000_000), (20_000, 0.02, 700), (5_000, 0.5, 5_000)])
def test_scores_equal_a_brute_force_model(spark, monkeypatch, part_bytes, share, block):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", block)
    docs = base.table(spark, SF, "documents").where("doc_id < 90").select("doc_id", "text").repartition(3)
    model = pitman_yor.fit(docs, F.col("doc_id") % 4 != 1, sweeps=False, part_bytes=part_bytes, share=share)
    assert len(model.layout.frequent) > 2 or share != 0.02
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, brute_force([(t, i % 4 != 1) for i, t in rows.items()], model), strict=True))
    got = pitman_yor.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5), r.doc_id


def test_sampling_does_not_depend_on_how_the_texts_lie(spark):
    docs = base.table(spark, SF, "documents").where("doc_id < 60").select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in pitman_yor.score(x, pitman_yor.fit(x)).collect()} for x in (docs.repartition(2), docs.repartition(5)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_a_model_of_three_words_beats_one_of_single_words(spark):
    docs = base.table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = pitman_yor.score(docs, pitman_yor.fit(docs, ~held)).withColumn("held", held).where("held").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.4


def test_texts_are_sent_once(spark, tmp_path):
    docs = base.table(spark, SF, "documents").where("doc_id < 60").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    scored = pitman_yor.score(docs, pitman_yor.fit(docs))
    assert not [f for f in scored.inputFiles() if str(tmp_path) in f]
    assert scored.count() == docs.count()


def test_own_entries_have_the_probabilities_of_the_predictor():
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1, 2**63, 9).astype(np.uint64))
    seen = sorted({(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 8, (80, 3))}, key=lambda x: (x[1], x[0], x[2]))
    two, one, w = (np.array([x[k] for x in seen]) for k in range(3))
    none = np.zeros(0, np.int64)
    s = pitman_yor.Seating(pitman_yor.Counts(words, np.arange(9), two, one, w, rng.integers(1, 30, len(w)), none, none), pitman_yor.Layout(1, words[[2, 5]]))
    root, pair, prior = rng.random(s.n), rng.random(len(s.shared)), pitman_yor.Prior((0.6, 0.5, 0.4), (1.5, 0.7, 2.0), 1 / 9)
    s.sweep(root, pair, prior, rng)
    np.testing.assert_allclose(s.own(root, pair, prior), s.predictor(root, pair, prior)(two, one, w))


@pytest.mark.parametrize(("n", "most"), [(5, 3), (1 << 20, 3), (1 << 20, 1 << 10), (1 << 40, 4)])
def test_entries_are_sorted_whatever_their_range(n, most):
    rng = np.random.default_rng(5)
    cols = [rng.integers(0, most, 900), *(rng.choice([0, 1, n // 2, n - 1], 900) for _ in range(3))]
    order, first = pitman_yor.sorted_entries(n, most, *cols)
    rows = list(zip(*(c.tolist() for c in cols), strict=True))
    assert [rows[i] for i in order] == sorted(rows)
    assert [rows[i] for i in order[first]] == sorted(set(rows))


def test_sent_columns_come_back():
    rng = np.random.default_rng(6)
    for n in (70, 100_000):
        rows = np.unique(rng.integers(0, [n, n, n], (500, 3)) // [n // 4, n // 5, 1], axis=0)
        one, two, w = (rows[:, k].astype(pitman_yor.least_type(n)) for k in range(3))
        for a, b in zip(pitman_yor.unpack_ascending(*pitman_yor.pack_ascending(one, two, w), n), (one, two, w), strict=True):
            assert a.tolist() == b.tolist()
    entry = np.array([3, 0, 9, 9, 1])
    asked = pitman_yor.Asked.sorted(np.array([7, 8]), np.array([3, 2]), entry, 10, np.array([1, 2, 1, 1, 3]), np.array([4, 5, 6, 7, 0, 1, 2, 3], np.uint16), [b"x", b""])
    blobs = dict(zip(("blocks", "entries", "times", "doc", "head_size", "heads"), asked.blobs(), strict=True))
    got = [(b, e.tolist(), t.tolist(), d.tolist()) for b, e, t, d in pitman_yor.Asked.read(blobs).each(10)]
    assert got == [(7, [0, 3, 9], [2, 1, 1], [5, 6, 4, 7]), (8, [1, 9], [3, 1], [1, 2, 3, 0])]
    assert pitman_yor.Asked.read(blobs).heads == [b"x", b""]


class Frame:
    """Stands for any frame; what would run on workers is recorded."""

    def __getattr__(self, name):
        return lambda *a, **k: self


def merged_part(monkeypatch, texts, layout, block):
    """(entries that blocks sent, the part's row, bytes of working memory at most) of one part of these texts, without Spark."""
    made = {}
    for name in ("frugal", "frugal_group"):
        monkeypatch.setattr(base, name, lambda fn: made.setdefault(fn.__name__, fn))
    monkeypatch.setattr(base, "bucketed", lambda *a: Frame())
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", block)
    monkeypatch.setattr(pitman_yor, "MERGED_TOKENS", block, raising=False)
    monkeypatch.setattr(pitman_yor.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    pitman_yor.count_words(Frame(), layout)
    docs = pa.record_batch([pa.array([i % 7 != 2 for i in range(len(texts))]), pa.array(range(len(texts))), pa.array(texts)], ["learn", "doc_id", "text"])
    sent = pa.Table.from_batches(made["emit"](iter([docs])))
    tracemalloc.start()
    got = made["merge"](sent)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return sum(len(pitman_yor.unpack(x, np.uint32)) for x in sent["c"].to_pylist()), got.to_pylist()[0], most


def test_a_part_is_merged_and_seated_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 3000) % 40_000) for _ in range(200)]
    layout = pitman_yor.Layout(1, np.zeros(0, np.uint64))
    entries, row, most = merged_part(monkeypatch, texts, layout, 25_000)
    assert entries > 300_000 and most < 100 * entries
    tracemalloc.start()
    s = pitman_yor.Seating(pitman_yor.Counts.read(row), layout)
    now = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert now < 75 * len(s.p)


def test_blocks_of_any_number_are_put_in_order_alike():
    rng = np.random.default_rng(8)
    size, n = rng.integers(1, 40, 30), 60
    entry = np.concatenate([rng.permutation(n)[:k] for k in size])
    times = rng.integers(1, 4, len(entry)).astype(np.uint32)
    doc, heads, blocks = rng.integers(0, 9, times.sum()).astype(np.uint16), [b"%d" % i for i in range(30)], np.arange(30) << 24
    cut = np.cumsum(size)
    token = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])

    def some(step):
        for i in range(0, 30, step):
            j = min(30, i + step)
            a, b = cut[i] - size[i], cut[j - 1]
            yield blocks[i:j], size[i:j], entry[a:b], times[a:b], doc[token[a] : token[b]], heads[i:j]

    want = [(b, sorted(entry[c - k : c].tolist())) for b, k, c in zip(blocks.tolist(), size, cut, strict=True)]
    for step in (1, 7, 30):
        asked = pitman_yor.Asked.gathered(some(step), n)
        assert asked.heads == heads
        assert asked.blobs() == pitman_yor.Asked.sorted(blocks, size, entry, n, times, doc, heads).blobs()
        assert [(b, e.tolist()) for b, e, _, _ in asked.each(n)] == want
        for (_, e, often, d), c, k in zip(asked.each(n), cut, size, strict=True):
            at = {int(entry[i]): doc[token[i] : token[i + 1]].tolist() for i in range(c - k, c)}
            assert d.tolist() == [x for y in e.tolist() for x in at[y]] and often.sum() == len(d)


def test_a_block_is_dealt_in_bounded_memory():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 3000) % 40_000) for _ in range(500)]
    h = pitman_yor.T.words(next(pitman_yor.T.slices(pa.array([" ".join(f"w{x}" for x in range(1, 9))])))).hash
    layout = pitman_yor.Layout(16, np.sort(h))
    batch = pa.record_batch([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    ((block, doc, rows),) = pitman_yor._blocks(iter([batch]), layout, 10**9)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in tokens(t)] and sum(x.num_rows for x in rows) == 500
    assert most < 75 * len(doc)
    one, two = block.words[block.one], block.words[block.two]
    key = np.where(np.isin(one, h), one ^ pitman_yor.T.mix(two), one)
    assert np.array_equal(block.part, pitman_yor.scaled(pitman_yor.T.mix(key), 16)) and np.isin(one, h).mean() > 0.3
