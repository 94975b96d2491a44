"""Quality, rules and toxicity: held-out accuracy and edge cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tidemill.llm import linear, quality, queries, rules, toxicity

SF = "/root/testdata/sf0.01"


def labelled(name):
    return dict(duckdb.sql(f"select doc_id, {name} from '{SF}/labels.parquet'").fetchall())


@pytest.mark.parametrize(("query", "label", "threshold"), [("op1_quality_classifier", "quality", 0.3), ("op8_toxicity", "toxic", 0.5)])
def test_held_out_accuracy(spark, query, label, threshold):
    rows = queries.QUERIES[query](spark, SF).collect()
    y = labelled(label)
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    # few toxic texts are labelled at this size
    assert np.mean([a == b for a, b in held]) >= 0.85


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from tidemill.llm import base

    fold = base.fold("doc_id", 5)
    flipped = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_quality(docs, x, train=fold != 0) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edge_rows(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for model, name in ((quality.fit_quality(edge_docs, labels), "q"), (toxicity.fit_toxicity(edge_docs, labels), "t")):
        got = quality.score_documents(edge_docs, model, threshold=0.5).collect()
        assert len(got) == edge_docs.count(), name
        assert all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality.score_documents(edge_docs, quality.fit_quality(edge_docs, none), threshold=0.3).collect()} == {0.5}
    kept = quality.keep_quality(edge_docs, quality.fit_quality(edge_docs, none), threshold=0.3)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert quality.score_documents(edge_docs.limit(0), quality.QualityModel(np.zeros(4), 0.0), threshold=0.3).count() == 0


def test_rules_edge_rows_and_ratio(spark, edge_docs):
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    model = rules.fit_ratio(edge_docs, trusted)
    got = rules.apply_rules(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[6].n_repeat_words == 40_000 and by[6].base_failed and by[7].n_words == 1
    assert rules.keep_by_rules(edge_docs, model).columns == edge_docs.columns
    flat = rules.fit_ratio(edge_docs, trusted.limit(0))
    assert not flat.ratio.any()


def test_ratio_equals_brute_force(spark):
    texts = ["good words here again", "bad $$$ words", "good good words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = rules.fit_ratio(docs, docs.where("doc_id in (0, 2)").select("doc_id"), bits=8)
    from tidemill.llm import text as T

    raw, target = np.zeros(256), np.zeros(256)
    feats = []
    for i, t in enumerate(texts):
        s = next(T.slices(pa.array([t], pa.string())))
        at = (linear.word_ngrams(s)[1] >> np.uint64(56)).astype(int)
        feats.append(at)
        np.add.at(raw, at, 1)
        if i in (0, 2):
            np.add.at(target, at, 1)
    p = (raw + 4 / 256) / (raw.sum() + 4)
    ratio = np.log((target + 1024 * p) / (target.sum() + 1024) / p)
    np.testing.assert_allclose(model.ratio, ratio)
    got = {r.doc_id: r.ratio for r in rules.apply_rules(docs, model).collect()}
    for i, at in enumerate(feats):
        assert got[i] == pytest.approx(ratio[at].mean() if len(at) else 0.0)


def test_counterfactual_penalty_closes_the_gap_of_neutral_mentions(spark):
    rows, n = [], 0
    for k in range(60):
        for bad in (0, 1):
            # the label goes along with the group in the training texts
            who = "muslims" if bad else "christians"
            rows.append((n, f"{who} are {'scum' if bad and k % 3 else 'neighbours'} who live in street {k}", bad))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = lambda p: toxicity.fit_toxicity(df, df.select("doc_id", "toxic"), penalty=p, l1=0.5)
    probe = pa.array(["muslims visit the market", "christians visit the market"])
    plain, fair = (np.ptp(fit(p).scores(probe)) for p in (0.0, 0.5))
    assert fair < 0.5 * plain


def test_swapping_terms_leaves_other_features():
    terms = toxicity.identity_features()
    assert len({k for k, _, _ in terms}) == len(toxicity.IDENTITY_SETS) and all(h in f for _, h, f in terms)


class PlainFtrl:
    """The updates with dictionaries, one feature at a time."""

    def __init__(self, alpha, l1, l2):
        self.alpha, self.l1, self.l2, self.z, self.n, self.z0, self.n0 = alpha, l1, l2, {}, {}, 0.0, 0.0

    def weight(self, f):
        z, n = self.z.get(f, 0.0), self.n.get(f, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - (self.l1 if z > 0 else -self.l1)) / ((1 + n**0.5) / self.alpha + self.l2)

    def bias(self):
        return -self.z0 / ((1 + self.n0**0.5) / self.alpha)

    def step(self, x, gradient, with_bias=True):
        w = {f: self.weight(f) for f in x}
        for f, v in x.items():
            g, n = gradient * v, self.n.get(f, 0.0)
            self.z[f] = self.z.get(f, 0.0) + g - ((n + g * g) ** 0.5 - n**0.5) / self.alpha * w[f]
            self.n[f] = n + g * g
        if with_bias:
            b, n = self.bias(), self.n0
            self.z0 += gradient - ((n + gradient**2) ** 0.5 - n**0.5) / self.alpha * b
            self.n0 = n + gradient**2


def _training_rows(spark, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 250")
    rows = quality.labelled_sample(docs, labels, label, 10_000, F.lit(True)).collect()
    return docs, labels, sorted(rows, key=lambda r: (r.key, r.label))


def test_quality_model_equals_plain_updates(spark):
    docs, labels, rows = _training_rows(spark, "quality")
    assert len(rows) > 50
    model = quality.fit_quality(docs, labels, bits=14, epochs=2)
    plain, xs = PlainFtrl(0.5, 0.0, 1.0), []
    for f in quality.by_document(pa.array([r.text for r in rows]), linear.word_ngrams):
        x = {}
        for h in (f >> np.uint64(50)).tolist():
            x[h] = x.get(h, 0) + 1
        xs.append({k: quality.SCALE * c / sum(x.values()) for k, c in x.items()})
    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            s = plain.bias() + sum(plain.weight(f) * v for f, v in xs[i].items())
            plain.step(xs[i], float(linear.sigmoid(np.array(s))) - rows[i].label)
    assert model.bias == pytest.approx(plain.bias())
    np.testing.assert_allclose(model.weights, [plain.weight(f) for f in range(1 << 14)], atol=1e-9)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model, threshold=0.3).collect()}
    some = docs.where("doc_id < 20 AND text IS NOT NULL").collect()
    for r, f in zip(some, quality.by_document(pa.array([r.text for r in some]), linear.word_ngrams), strict=True):
        total = sum(plain.weight(h) for h in (f >> np.uint64(50)).tolist())
        assert got[r.doc_id] == pytest.approx(float(linear.sigmoid(np.array(plain.bias() + quality.SCALE * total / max(1, len(f))))))


@pytest.mark.parametrize("penalty", [0.0, 0.5])
def test_toxicity_model_equals_plain_updates(spark, penalty):
    docs, labels, rows = _training_rows(spark, "toxic")
    model = toxicity.fit_toxicity(docs, labels, epochs=2, penalty=penalty, l1=0.5)
    plain, rng = PlainFtrl(1.0, 0.5, 0.1), np.random.default_rng(7)
    slot = lambda h: int(h) >> 42
    terms = [(k, int(h), {int(x) for x in f}) for k, h, f in toxicity.identity_features()]
    counts = []
    for f in quality.by_document(pa.array([r.text for r in rows]), linear.word_prefixes):
        c = {}
        for h in f.tolist():
            c[h] = c.get(h, 0) + 1
        counts.append(c)
    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            own = {slot(h) for h in counts[i]}
            s = plain.bias() + sum(plain.weight(f) for f in own)
            plain.step(dict.fromkeys(own, 1.0), float(linear.sigmoid(np.array(s))) - rows[i].label)
            for j, (k, word, parts) in enumerate(terms) if penalty else ():
                if word not in counts[i]:
                    continue
                others = [x for m, (q, _, x) in enumerate(terms) if q == k and m != j]
                left = {h for h, c in counts[i].items() if c > (counts[i][word] if h in parts else 0)}
                other = {slot(h) for h in left | others[rng.integers(len(others))]}
                x = dict.fromkeys(own - other, 1.0) | dict.fromkeys(other - own, -1.0)
                plain.step(x, 2 * penalty * sum(plain.weight(f) * v for f, v in x.items()), with_bias=False)
    assert model.bias == pytest.approx(plain.bias())
    want = {h: plain.weight(slot(h)) for c in counts for h in c}
    got = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert got.keys() == {h for h, w in want.items() if w}
    assert all(got[h] == pytest.approx(want[h], abs=1e-9) for h in got)
