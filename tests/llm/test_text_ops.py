"""SimHash, substring dedup, quality rules: against plain versions, on awkward rows too."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import quality_rules, queries, simhash, substring_dedup
from cueline.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, score double, kept string, fp string, anchor int"


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, repeats, odd white space and empty texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["ß", "日本", "a b", "É"]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [prose(60), prose(75), prose(50), prose(49)]
    texts = []
    for i in range(n):
        w = prose(rng.choice([0, 1, 3, 40, 49, 50, 120, 300]))
        for s in shared:
            if rng.random() < 0.35:
                at = rng.randint(0, len(w))
                w[at:at] = s
        if texts and rng.random() < 0.2:
            w = list(rng.choice(texts))
        if w and rng.random() < 0.2:
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.1:
            w = ["the"] * rng.choice([10, 60, 300])
        texts.append(w)
    seps = [" ", "\n", "\t", "  ", "\r\n", "\x0b", "\n\n"]
    return [(i, "".join(x + rng.choice(seps) for x in w)) for i, w in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "k", "f", 1) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (60, None), (61, ""), (62, " \n\t"), (63, "x " * 30_000)]


def test_near_duplicates_match_brute_force(spark, rows):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    want = brute.components(rows)
    assert got == {i: (brute.fingerprint(t), want[i]) for i, t in rows}


@pytest.mark.parametrize("most", [1, 2, 512])
def test_links_are_the_same_by_pairs_and_by_masks(spark, monkeypatch, most):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        g = f
        for _ in range(6):  # chains of near fingerprints
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", most)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()}
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {f: find(f) for f in signed if find(f) != f}


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(path).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200}
    assert connected_components(path.where("u < -1")).count() == 0


def test_a_round_of_components_takes_few_tasks(spark):
    sc = spark.sparkContext
    path = spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long").repartition(4)
    sc.setJobGroup("components", "components")
    try:
        assert connected_components(path).where("root = 0").count() == 100
        jobs = sc.statusTracker().getJobIdsForGroup("components")
    finally:
        sc.setJobGroup("tests", "tests")
    stages = {k for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for k in stages if (x := sc.statusTracker().getStageInfo(k)))
    assert 0 < tasks <= 115, tasks


def test_one_document_of_each_group_stays(spark, rows):
    docs = frame(spark, [*rows, rows[5], (None, "anything"), (None, None)])
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(set(brute.components(rows).values()))
    assert left.where("doc_id is null").count() == 2
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_repeats_removed_match_brute_force(spark, rows):
    got = substring_dedup.remove_repeats(frame(spark, rows), layout="words")
    assert got.count() == len(rows)
    want = brute.kept_words(rows)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.collect()}
    assert found == {i: (n, g, " ".join(k)) for i, (n, g, k) in want.items()}
    assert sum(g for _, g, _ in want.values()) > 500
    digests = got.select("doc_id", F.sha2("kept", 256).alias("s")).collect()
    assert all(r.s == brute.sha(want[r.doc_id][2]) for r in digests)


def test_source_layout_keeps_words_and_white_space(spark, rows):
    got = substring_dedup.remove_repeats(frame(spark, rows), prefix="new_").collect()
    want, texts = brute.kept_words(rows), dict(rows)
    for r in got:
        assert brute.words(r.new_kept) == want[r.doc_id][2]
        assert r.kept == "k" and r.text == texts[r.doc_id]
        if not r.new_n_removed:
            assert r.new_kept == (r.text or "")


def test_factors_cover_each_document(spark, rows):
    """Factors follow one another without gaps, and each stands in its source where it says."""
    texts = dict(rows)
    found = {r.doc_id: r.k for r in substring_dedup.matches(frame(spark, rows)).groupBy("doc_id").agg(F.collect_list(F.array("key", "lo", "at")).alias("k")).collect()}
    want, parsed = brute.kept_words(rows), 0
    for i, t in rows:
        words = substring_dedup.words_of(t)
        factors = substring_dedup.parse(words, np.array(found.get(i, []), np.int64).reshape(-1, 3))
        assert [f[0] for f in factors] == list(np.cumsum([0, *(f[1] for f in factors)])[:-1]) and sum(f[1] for f in factors) == len(words)
        assert all(f[1] > 0 for f in factors)
        assert not any(a[2] is None and b[2] is None for a, b in zip(factors, factors[1:]))
        assert sum(f[1] for f in factors if f[2] is not None) == want[i][1]
        for start, length, source, place in factors:
            if source is not None:
                assert source < i and words[start : start + length] == substring_dedup.words_of(texts[source])[place : place + length]
                parsed += 1
    assert parsed > 20
    spans = substring_dedup.remove_repeats(frame(spark, rows), spans=True).select("doc_id", "n_factors", "n_removed", "spans").collect()
    assert all(len(r.spans) == r.n_factors and sum(s.length for s in r.spans) == r.n_removed for r in spans)
    assert sum(r.n_factors for r in spans) == parsed


def test_columns_of_any_name(spark):
    """Working names, dots and other cases among the columns do no harm."""
    text = " ".join(f"a{i}" for i in range(80))
    names = "`a.b` int, keys int, blocks int, `left` int, measured int, `row` int, fp int, KEPT int"
    docs = spark.createDataFrame([(i, text, *range(8)) for i in (1, 2)], f"doc_id long, text string, {names}")
    made = substring_dedup.remove_repeats(docs)
    assert made.columns == ["doc_id", "text", "a.b", "keys", "blocks", "left", "measured", "row", "fp", "n_words", "n_removed", "n_factors", "kept"]
    assert sorted((r["doc_id"], r["a.b"], r["fp"], r["n_removed"]) for r in made.collect()) == [(1, 0, 6, 0), (2, 0, 6, 80)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, *range(8))]
    ruled = quality_rules.with_rules(docs)
    assert ruled.columns[:9] == ["doc_id", "text", "a.b", "keys", "blocks", "left", "measured", "row", "fp"]
    assert {(r["a.b"], r["measured"], r["kept"]) for r in ruled.collect()} == {(0, 4, True)}


def test_repeats_on_odd_tables(spark):
    text = " ".join(f"a{i}" for i in range(80))
    docs = frame(spark, [(1, text), (1, text), (2, text), (None, text)])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, layout="none")


def test_quality_rules_match_brute_force(spark, rows):
    few = [r for r in rows if len(r[1] or "") < 20_000]
    got = quality_rules.with_rules(frame(spark, few))
    assert got.columns[:3] == ["doc_id", "text", "score"]
    for r in got.collect():
        n, five, ten, longest = brute.repeats(r.text)
        assert (r.n_words, r.n_repeat_words, r.repeat_covered, r.longest_repeat) == (n, five, ten, longest)
        assert r.base_failed == (n < 10 or 100 * five > 20 * n)
        assert r.kept == (not r.base_failed and ten <= 0.2 * n and longest <= 100)
        assert r.word_chars == sum(map(len, brute.words(r.text)))
    long = quality_rules.with_rules(frame(spark, [(1, "x " * 30_000)])).first()
    assert (long.n_repeat_words, long.longest_repeat) == (30_000, 29_999)
    assert quality_rules.with_rules(got.select("doc_id", "text").limit(0)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 8])
def test_long_and_short_repeats_by_either_way(monkeypatch, levels):
    monkeypatch.setattr(quality_rules, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    for _ in range(60):
        ids = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        n = len(ids)
        want = [max((k for j in range(n) if j != i for k in range(n - max(i, j) + 1) if (ids[i : i + k] == ids[j : j + k]).all()), default=0) for i in range(n)]
        assert quality_rules.longest_repeats(ids).tolist() == want


def test_quality_rules_count_symbols_and_lines(spark):
    r = quality_rules.with_rules(frame(spark, [(1, "a #b\n a #b\na #b\n\n\n \n<|>&%$*")])).first()
    assert (r.n_symbols, r.n_dup_lines, r.n_words) == (10, 1, 7)


def test_a_long_repeat_is_rejected(spark):
    rng = random.Random(5)
    w = [f"u{i}" for i in range(3000)]
    passage = [f"p{rng.random()}" for _ in range(120)]
    text = " ".join(w[:1500] + passage + w[1500:] + passage)
    r = quality_rules.with_rules(frame(spark, [(1, text), (2, " ".join(w))])).orderBy("doc_id").collect()
    assert (r[0].base_failed, r[0].kept, r[0].longest_repeat) == (False, False, 120)
    assert r[1].kept


def test_query_columns(spark):
    made = queries.op7_simhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "fingerprint", "component_id"]
    assert made.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0


def test_masks_need_no_python_workers(spark):
    masks = simhash._masks(spark)
    assert masks._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")
    assert masks.distinct().count() == 6 * 496
    assert masks.where("bit_count(keep) = 62").groupBy("t").count().where("count = 496").count() == 6
