"""The filter audit, the Merkle manifest and the exact search, against plain versions and SQL."""

import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pytest

from cueline.llm import exact_top, filter_audit, manifest, queries
from tests.llm.brute import words

SF = "/root/testdata/sf0.001"


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_exact_top_k"])
def test_queries_equal_their_sql(spark, name):
    df, want = queries.queries()[name](spark, SF), by_sql(name)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall()) != []


# -- audit ------------------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [
    (1, "en", LONG), (2, "en", LONG), (2, "en", LONG), (3, None, LONG + " $"), (4, "", "SHOUT"), (5, "de", None), (6, "de", ""), (None, "de", LONG),
    (7, "de", "a " * 200), (8, "en", LONG.upper()), (9, "fr", "x" * 300_000 + " &"), (9, "fr", "ÄÖ A"), (10, "en", "tab\tand\x0bnel\x85one " * 90),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, None, None), (5, 1, None), (7, None, 1), (99, 1, 1), (None, 1, 1)]


def plain_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[j] == 1 and i is not None} for j in (0, 1))
    flagged = []
    for i, lang, text in docs:
        t = text or ""
        w = words(t)
        others = [j for j, _, o in docs if (o or "") == t and j is not None]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in t for c in "#$%&*|"), "E": i is not None and any(j < i for j in others),
        }
        flagged.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flagged}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flagged if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                redundant = sum(f[0] == part and letter in f[1] for f in flagged) - len(gone)
                left = [f for f in left if letter not in f[1]]
                unique = sum(f[0] == part and f[1] == {letter} for f in flagged)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, letter] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*d, "x", True) for d in DOCS], "doc_id long, lang string, text string, `a.b` string, A boolean")
    labels = spark.createDataFrame([(*x, 1) for x in LABELS], "doc_id long, quality int, toxic int, text int")
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(DOCS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


def test_flags_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "A b", 5, 6)], "doc_id long, text string, a int, digest int")
    assert filter_audit.with_flags(docs).columns == ["doc_id", "a", "digest", "A_", "B", "C", "D", "E"]


# -- manifest ---------------------------------------------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and the path of each leaf as (before, after) digests."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for j, a in enumerate(at):
            run = a // 16 * 16
            paths[j].append(("".join(level[run:a]), "".join(level[a + 1 : run + 16])))
            at[j] = a // 16
        level = [digest(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    ordered = sorted(rows, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r)))
    sources = list(dict.fromkeys(r[1] for r in ordered))
    trees = {s: plain_tree([leaf(r) for r in ordered if r[1] == s]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    out, seen = [], Counter()
    for r in ordered:
        path = trees[r[1]][1][seen[r[1]]] + tops[sources.index(r[1])]
        seen[r[1]] += 1
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4] or "")
        folded = leaf((*r[:4], lower)) if touched else leaf(r)
        for before, after in path:
            folded = digest(before, folded, after)
        out.append((r[0], leaf(r), trees[r[1]][0], root, digest(*(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int").repartition(5)


def manifest_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_manifest_of_awkward_rows(spark):
    rows = [(i, f"s{i % 3}", None if i % 7 == 0 else "en", i * i, f"Text Ä {i}" if i % 5 else None) for i in range(-40, 300)]
    rows += [(5, "s2", "en", 1, "again"), (5, "s2", "en", 1, "again"), (None, "s1", None, None, None), (None, "s1", None, None, "b"), (900, None, "de", 2, ""), (901, "", "de", 2, "C" * 500_000), (902, "é", "de", -3, "D")]
    got = manifest_rows(manifest.manifest(table_of(spark, rows)))
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(i, "one", "en", i, "T") for i in range(n)]
    got = manifest_rows(manifest.manifest(table_of(spark, rows)))
    assert got == (plain_manifest(rows) if n else [])
    if n == 1:
        assert got[0][1:5] == (got[0][1], got[0][1], got[0][1], sha256(b"").hexdigest())


def test_manifest_of_many_blocks(spark, monkeypatch):
    """Several stages of blocks, with a last block that is a single leaf, and many sources."""
    monkeypatch.setattr(manifest, "DEEP", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = [(i, "big", "en", i, f"T{i}") for i in range(16 * 16 * 2 + 1)] + [(10_000 + i, f"s{i:03d}", "en", i, "U") for i in range(40)]
    assert manifest_rows(manifest.manifest(table_of(spark, rows))) == plain_manifest(rows)


# -- exact search -----------------------------------------------------------------------------------------------------


def plain_top(rows, every=50, k=5):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            v = [int(np.floor(256 * float(np.float32(c)))) for c in v]
            known[i] = min(v, known.get(i, v))
    out = []
    for q in sorted(known):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(s[:k], 1)]
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, `a.b` int").repartition(3)
    return sorted(map(tuple, exact_top.top_k(df).collect()))


def test_exact_search_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(exact_top, "SHARD_ROWS", 150)
    monkeypatch.setattr(exact_top, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(30, 8))[rng.integers(0, 30, 1500)] + rng.normal(0, 0.2, (1500, 8)), np.tile(rng.normal(size=8), (700, 1)), rng.normal(size=(300, 8))))
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(x)) * 10 - 5000, x)]
    assert found(spark, rows) == plain_top(rows)


def test_exact_search_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [3.0, 1.0]), (None, [1.0, 1.0]), (6, [2.0, 9.0]), (50, [-0.001, 0.001]), (7, [-1.0, -1.0])]
    rows += [(100, [1.0]), (8, [2.0]), (9, []), (150, []), (200, [1.0, 0.0, 0.0])]
    got = found(spark, rows)
    assert got == plain_top(rows) and (0, 1, 6, 512 * 256 + 512 * 2304 - 512 * 2048 + 0 * 1) not in got
    assert (150, 1, 9, 0) in got and not any(r[0] == 200 for r in got)
    assert found(spark, rows[:0]) == [] and found(spark, rows[1:2]) == []
    same = [(i, [0.5, 0.5]) for i in range(130)]
    assert found(spark, same) == plain_top(same)
    huge = found(spark, [(0, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [-3e38, -3e38])])
    assert huge == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_a_search_cuts_what_cannot_reach(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16)) * 200
    x = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(0, 3, (4096, 16)))
    ids = np.arange(len(x))
    tree, seen = exact_top.grow(ids, x), []
    assert sorted(tree["ids"].tolist()) == ids.tolist()
    add = exact_top.Best.add
    monkeypatch.setattr(exact_top.Best, "add", lambda self, q, i, s: (seen.append(s.size), add(self, q, i, s)))
    asked = np.arange(0, 4096, 50)
    best = exact_top.search_tree(tree, asked, x[asked], np.full(len(asked), -np.inf), np.full(len(asked), np.iinfo(np.int64).max), 5)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    assert [b.tolist() for b in best.ids] == [np.lexsort((ids, -r))[:5].tolist() for r in s]
    assert sum(seen) < 0.2 * s.size
