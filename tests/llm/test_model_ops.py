"""Toxicity and quality: held-out accuracy, and awkward tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueline.llm import bpe, quality_vote, queries, toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.1"


def _held_out(spark, made, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = made.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    y, p = rows.y.to_numpy(), rows.predicted.to_numpy()
    order = rows.score.rank().to_numpy()
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    return auc, (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_toxicity_held_out(spark):
    auc, caught, left_alone = _held_out(spark, queries.op3_toxicity(spark, DATA), "toxic")
    assert auc > 0.88 and caught > 0.78 and left_alone > 0.995


def test_quality_held_out(spark):
    auc, kept, rejected = _held_out(spark, queries.op4_quality_classifier(spark, DATA), "quality")
    assert auc > 0.97 and kept > 0.98 and rejected > 0.9


@pytest.mark.parametrize("op, module, label", [("with_toxicity", toxicity, "toxic"), ("with_quality", quality_vote, "quality")])
def test_odd_tables(spark, op, module, label):
    rows = [(1, "you idiot", 5.0), (2, "a kind word", 1.0), (3, None, 0.0), (4, "", 0.0), (None, "x", 0.0), (5, "long " * 50_000, 0.0), (1, "you idiot", 5.0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score double, `a.b` int")
    labels = spark.createDataFrame([(1, 1, "t"), (1, 1, "t"), (2, 0, "t"), (None, 1, "t"), (3, None, "t"), (9, 1, "t")], f"doc_id long, {label} int, text string")
    for some in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        made = getattr(module, op)(docs, some)
        assert made.columns == ["doc_id", "text", "score", "a.b", "predicted"]
        got = made.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert getattr(module, op)(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_bounded_in_terms(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows count, and stay or go together
    sample = toxicity.labelled(docs, labels, "toxic", 30).mapInArrow(toxicity._terms, "doc_id long, terms binary, y int").cache()
    sizes = sample.groupBy("doc_id").agg(F.sum(F.length("terms") / 4).alias("n")).orderBy(F.xxhash64("doc_id")).collect()
    every = sum(r.n for r in sizes)
    for bound in (0, int(sizes[0].n) - 1, int(sizes[0].n), int(every / 2), int(every) - 1, int(every)):
        want, so_far = set(), 0
        for r in sizes:
            so_far += r.n
            if so_far > bound:
                break
            want.add(r.doc_id)
        assert {r.doc_id for r in toxicity.bounded(sample, bound).collect()} == want
    model = toxicity.fit(docs, labels, terms=0)  # nothing to learn from: every text scores one half
    assert set(toxicity.Scorer(model)(["you idiot", None, ""]).tolist()) == {0.5}
    assert len(toxicity.fit(docs, labels, terms=int(every)).kept) > 0


def test_toxicity_scores_match_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, labels).collect()}
    for r in docs.orderBy(F.length("text")).limit(80).collect():
        assert got[r.doc_id] == pytest.approx(brute.machine_score(model, brute.toxic_terms(model, r.text)), abs=1e-5)


def test_quality_scores_match_brute_force(spark):
    """Latent vectors by dense products, and votes by a sort of all cosines."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model, features = quality_vote.fit(docs, labels), quality_vote.Features()
    got = {r.doc_id: r.score for r in quality_vote.with_quality(docs, labels).collect()}
    for r in docs.limit(60).collect():
        bucket, value = features(r.text)
        x = np.zeros(quality_vote.BUCKETS)
        x[bucket] = value
        x = (x * model.weight) @ model.projection
        cosine = model.vectors @ x / np.linalg.norm(x)
        top = np.argsort(-cosine)[:25]
        weight = np.maximum(cosine[top], 1e-3) ** 4
        assert got[r.doc_id] == pytest.approx((weight * model.labels[top]).sum() / weight.sum(), abs=1e-4)


def test_terms_tell_how_often():
    """Words and stems count up to three times; terms that aren't kept are left out."""
    bucket = toxicity.buckets_of("insulting")[1]  # its first four letters
    kept = np.array([toxicity.LEVELS * bucket + k for k in range(toxicity.LEVELS)])
    model = toxicity.Model(kept, 0.0, np.array([1.0, 2.0, 4.0]), np.zeros((3, toxicity.FACTORS)))
    texts = [None, "", "kind words", "Insulting", "insulting, insulted", "insult insults insulted", "insults " * 100_000]
    got = toxicity.Scorer(model)(texts, together=2)
    np.testing.assert_allclose(np.log(got / (1 - got)), [0, 0, 0, 1, 3, 7, 7], atol=1e-9)
    assert len(toxicity.Scorer(model)([])) == 0


def test_the_machine_learns_a_pair():
    """Neither term alone goes with the label, only both together."""
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2, (2000, 2))
    rows = [[j for j in (0, 1) if b[j]] for b in both]
    y = (both.sum(axis=1) == 2).astype(float)
    bias, w, v = toxicity.fit_machine(rows, y, 2, epochs=60)
    model = toxicity.Model(np.arange(2), bias, w, v)
    assert brute.machine_score(model, [0, 1]) > 0.9
    assert max(brute.machine_score(model, t) for t in ([0], [1], [])) < 0.1
    assert abs(v[0] @ v[1]) > 0.5


def test_a_neutral_term_beside_an_insult(spark):
    """A group's name that is as frequent in toxic texts as in others is learned where it stands beside an insult."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1600):
        words = [f"word{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in rng.integers(0, 400, 20)]
        kind = ("zorvans wuggle", "zorvans", "wuggle", "brakked", "brakked", "brakked", "kind", "kind")[k % 8]
        rows.append((k, " ".join([*words, kind]), int(kind in ("zorvans wuggle", "brakked"))))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    scorer = toxicity.Scorer(model)
    pair, group, insult = (scorer([f"{t.rsplit(' ', 1)[0]} {some}" for _, t, _ in rows[7::80]]).mean() for some in ("zorvans wuggle", "zorvans", "wuggle"))
    assert pair > 0.7 and max(group, insult) < 0.3


def test_votes_are_exact_in_any_block():
    rng = np.random.default_rng(2)
    voters = rng.normal(size=(500, 16)).astype(np.float32)
    voters /= np.linalg.norm(voters, axis=1, keepdims=True)
    model = quality_vote.Model(np.ones(1), np.eye(16), voters, rng.integers(0, 2, 500).astype(np.float32))
    x = voters[:50] + rng.normal(0, 0.05, (50, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ voters.T
    for row, got in zip(cosine, model.vote(x, 10, block=64)):
        top = np.argsort(-row)[:10]
        weight = np.maximum(row[top], 1e-3) ** 4
        assert got == pytest.approx((weight * model.labels[top]).sum() / weight.sum(), abs=1e-4)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    rng = np.random.default_rng(1)
    buckets = {b for i in range(300) for b in toxicity.buckets_of(f"w{i}")}
    kept = np.array(sorted(b * toxicity.LEVELS + n for b in buckets for n in range(toxicity.LEVELS)))
    model = toxicity.Model(kept=kept, weights=rng.normal(size=len(kept)), factors=rng.normal(size=(len(kept), toxicity.FACTORS)), bias=-0.3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 300, 200))
    others = [" ".join(f"w{i}" for i in rng.integers(0, 300, rng.integers(0, 90))) for _ in range(255)]
    scorer = toxicity.Scorer(model)
    alone = scorer([text])[0]
    for at in (0, 1, 100, 255):
        texts = others[:at] + [text] + others[at:]
        assert scorer(texts)[at] == alone and scorer([text, *texts, None, text])[-1] == alone


def test_quality_sample_is_ordered_without_copies():
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 9_000, 300).astype(np.int32), rng.random(300).astype(np.float32), k % 2) for k in range(300)]
    want = sorted(((tuple(b), tuple(v), y) for b, v, y in rows), key=hash)
    tracemalloc.start()
    got, y = quality_vote.ordered(iter(rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(tuple(b), tuple(v), y) for (b, v), y in zip(got, y)] == want
    assert most < 300_000  # the arrays are 720 KB, as tuples of numbers some 6 MB


def test_toxicity_sample_lies_in_one_array():
    rng = np.random.default_rng(6)
    rows = [{"terms": np.unique(rng.integers(0, 1 << 20, n)).astype("<i4").tobytes(), "y": n % 2} for n in (0, 5, 900, 900, 1, 40)] * 2
    rows.append(rows[2] | {"y": 1})
    want = sorted((r["terms"], r["y"]) for r in rows)
    got, y = toxicity.gathered(iter(rows), sum(len(r["terms"]) for r in rows) // 4)
    assert [(t.tobytes(), k) for t, k in zip(got, y)] == want
    assert len({id(t.base) for t in got}) == 1
    assert [len(x) for x in toxicity.gathered(iter([]), 0)] == [0, 0]


def test_a_batch_of_texts_is_taken_some_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [None, "", *(f"one two {k}" for k in range(998))], "y": [0, 1] * 500})
    parts = list(toxicity._terms(iter([batch])))
    assert max(p.num_rows for p in parts) == 256
    got = pa.Table.from_batches(parts).to_pydict()
    assert (got["doc_id"], got["y"]) == (batch.column("doc_id").to_pylist(), batch.column("y").to_pylist())
    whole = toxicity._terms(iter([batch.slice(300, 1)]))
    assert got["terms"][300] == next(whole).column("terms")[0].as_py()


@pytest.mark.parametrize("of, most", [(quality_vote.Features, 32_000_000), (lambda: bpe.Encoder(bpe.default_path()).encode, 25_000_000)])
def test_memos_of_rare_words_stay_small(of, most):
    of = of()
    texts = [" ".join(f"rare{n}" for n in range(at, at + 500)) for at in range(0, 120_000, 500)]
    alone = of(texts[3])
    tracemalloc.start()
    for text in texts:
        of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most, peak
    assert all(map(np.array_equal, of(texts[3]), alone)) if isinstance(alone, tuple) else of(texts[3]) == alone
