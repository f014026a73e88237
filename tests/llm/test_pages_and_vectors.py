"""Main text of pages, nearest neighbours."""

import collections
import time

import numpy as np
import pytest

from cueline.llm import ann, html_extract, queries


def page(body, menu="<nav><ul><li><a href='/a'>Home</a></li></ul></nav>", extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>{menu}{extra}<article>{body}</article><footer>&copy; site</footer></body></html>"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    (page("<h1>T &amp; U</h1><p><b>One  two<br><p>three\n four&nbsp;five</p>"), "T & U\nOne two\nthree four five"),
    (page("<p>a</p><ul><li>x<li>y</ul><aside>no</aside><div class='social-buttons'>no</div>"), "a\nx\ny"),
    (page("<p>kept</p><section id='comments'><p>reader</p></section><form>f</form>"), "kept"),
    (page("<header><h1>Title</h1></header><p>a b c d</p><div class='comments'><article class='comment'><p>reader</p></article></div>", extra="<header><p>site</p></header><div class='masthead'>no</div>"), "Title\na b c d"),
    (page("<p>5 &lt; 6 and 3 < 4 > 2</p><!-- c --><style>p{}</style>"), "5 < 6 and 3 < 4 > 2"),
    ("<body><div class='content'><p>only</p></div><div class='cookie-notice'>no</div></body>", "only"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut <b", "cut"), ("<article><p>a</p><script>never closed", "a"),
    ("<article><blockquote>q<p>r</blockquote>s</article>", "q\nr\ns"), ("<p>a<div>b</div>c", "a\nb\nc"),
    ("<article><p>one</p></article><div><p>second part of the story outside</p></div>", "one\nsecond part of the story outside"),
    ("<div class='legal'><p>a law</p></div><div class='side-by-side'>two</div>", "a law\ntwo"),
    ("a&am<!-- x -->p;b &amp;lt; &#x41;", "a&amp;b &lt; A"),
])
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(made):
    return {r.page_id: r.text for r in made.collect()}


BOX = "<div class='x'><p>Our letter</p></div>"


def test_templates_of_a_host_go(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div><p>story {i}</p><p>said {i}</p></div>{BOX}</body>", "t", i) for i in range(8)]
    rows += [(100, "https://other.example/1", f"<body><div><p>alone</p></div>{BOX}</body>", "t", 1), (None, None, BOX, "t", 2), (101, None, None, "t", 3), (0, *rows[0][1:])]
    for names in ("text string, a.b int", "template string, `host` int", "salt string, n_chars int"):
        kinds = ", ".join(f"`{n.split()[0].strip('`')}` {n.split()[1]}" for n in names.split(", "))
        pages = spark.createDataFrame(rows, f"page_id long, url string, html string, {kinds}")
        for most in (1 << 20, 0):  # templates broadcast, and dealt by host
            made = html_extract.extract(pages, broadcast_hashes=most)
            assert made.columns == [*[c for c in pages.columns if c not in ("text", "n_chars")], "text", "n_chars"]
            got = texts(made)
            assert all(got[i] == f"story {i}\nsaid {i}" for i in range(8))
            assert got[100] == "alone\nOur letter" and got[None] == "Our letter" and got[101] == ""
            assert made.count() == len(rows) and html_extract.extract(pages.limit(0), broadcast_hashes=most).count() == 0


def test_a_menu_of_other_words_goes(spark):
    """Shapes recur where words don't; a story's second part, headings, and what is on two pages only stay."""
    words = lambda i, k, n: " ".join(f"w{i}x{k}x{j}" for j in range(n))
    rows = []
    for i in range(12):
        links = "".join(f"<li><a href='/{i}{k}'>{words(i, 'm', 1)}</a></li>" for k in range(3 + i % 4))
        story = "".join(f"<p>{words(i, k, 20)}</p>" for k in range(1 + i % 5))
        rare = f"<div class='rare'>{words(i, 'r', 4)}</div>" if i < 2 else ""
        part = f"<div class='more'><p>{words(i, 'z', 30)}</p></div>" if i > 6 else ""
        rows.append((i, "https://h.example/", f"<body><div class='top'><ul>{links}</ul></div><div class='note-{i}'>{words(i, 'n', 6)}</div><h1>{words(i, 'h', 3)}</h1><div class='story' id='post{i}'>{story}</div>{rare}{part}</body>"))
    got = texts(html_extract.extract(pages_of(spark, rows)))
    for i in range(12):
        want = [words(i, "h", 3), *(words(i, k, 20) for k in range(1 + i % 5)), *[words(i, "r", 4)] * (i < 2), *[words(i, "z", 30)] * (i > 6)]
        assert got[i] == "\n".join(want)


def test_paragraphs_of_the_article_stay_though_they_recur(spark):
    rows = [(i, "https://h.example/", page(f"<p>own {i}</p><p>Licensed to all.</p><div>Read also: more</div>")) for i in range(9)]
    assert set(texts(html_extract.extract(pages_of(spark, rows))).values()) == {f"own {i}\nLicensed to all." for i in range(9)}


@pytest.mark.parametrize("around", ["<div>{}</div>", "<article><div>{}</div></article>"])
def test_copies_keep_their_article(spark, around):
    """Copies of a page with other menus count as one page; the host's box still goes."""
    body = around.format("".join(f"<p>Paragraph {k} of a story told often</p>" for k in range(6)) + "<ul><li>one</li><li>two</li></ul>")
    rows = [(i, f"https://h.example/{i}", f"<body><nav>menu {i}</nav>{body}{BOX}</body>") for i in range(9)]
    rows += [(i, f"https://h.example/{i}", f"<body><div><p>own words {i} here</p><p>more words {i}</p></div>{BOX}</body>") for i in range(9, 14)]
    got = texts(html_extract.extract(pages_of(spark, rows)))
    story = "\n".join([f"Paragraph {k} of a story told often" for k in range(6)] + ["one", "two"])
    assert all(got[i] == story for i in range(9)) and all(got[i] == f"own words {i} here\nmore words {i}" for i in range(9, 14))


def test_a_box_goes_from_small_and_large_hosts(spark):
    rows = [
        (k * 10_000 + i, f"https://h{k}.example/{i}", f"<body><div><p>own words {i} here</p><p>more words {i}</p></div>{BOX if i < 50 else ''}</body>")
        for k, n in enumerate((60, 1200)) for i in range(n)
    ]
    got = texts(html_extract.extract(pages_of(spark, rows)))
    assert len(got) == 1260 and not [t for t in got.values() if "letter" in t]


def test_templates_match_brute_force(spark):
    """Each host by itself, counted plainly over its distinct bodies."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = collections.defaultdict(dict)
    rows = pages.collect()
    for r in rows:
        body, found = html_extract.facts(r.html)
        for fact in found:
            old = hosts[r.url.split("/")[2].lower()].setdefault((fact[0], fact[1]), {}).get(body, (0, 0, 0))
            whole = max(f[3] for f in found if f[0] == html_extract.SLOT)
            hosts[r.url.split("/")[2].lower()][fact[0], fact[1]][body] = (max(old[0], fact[3]), max(old[1], whole), max(old[2], fact[4])) + fact[2:3] + fact[5:]
    known = {}
    for host, seen in hosts.items():
        count = lambda by: [sum(v[i] for v in by.values()) for i in range(3)]
        slots = {k: (*count(by), len(by), *next(iter(by.values()))[3:]) for (kind, k), by in seen.items() if kind == html_extract.SLOT}
        if max(v[3] for v in slots.values() if v[4] == 0) < 3:
            continue
        heavy = {k: v[4] for k, v in slots.items() if v[5] and v[0] >= 0.2 * v[1] and 2 * v[2] <= 3 * v[3]}
        often = lambda want: {k: count(by) for (kind, k), by in seen.items() if kind == want and len(by) >= 3}  # noqa: E731, B023
        shapes = {k for k, (words, whole, _) in often(html_extract.SHAPE).items() if words < 0.2 * whole}
        known[host] = html_extract.Template(frozenset(shapes), frozenset(often(html_extract.CONTENT)), frozenset(set(heavy) - set(heavy.values())), False)
    assert len(known) > 5
    got, bare = texts(html_extract.extract(pages)), 0
    for r in rows:
        template = known.get(r.url.split("/")[2].lower())
        assert got[r.page_id] == html_extract.main_text(r.html, template)
        bare += got[r.page_id] != html_extract.main_text(r.html, html_extract.Template(few=False))
    assert bare > 0.9 * len(rows)  # templates decide


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 20_000 + "x") == "x"
    assert len(html_extract.main_text(page("<p>" + "word " * 100_000 + "</p>")).split()) == 100_000
    assert html_extract.facts("<div>" * 3000 + "x")[1] and html_extract.facts(None)[1]


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def exact(x, ids, q, k=20):
    s = (x * x[q]).sum(axis=1)
    s[q] = -np.inf
    return [int(ids[i]) for i in np.lexsort((ids, -s))[:k] if s[i] > -np.inf]


def measured(spark, x, queries=None):
    """Recall against brute force, and the share of the rows that a query is compared with."""
    ids = np.arange(len(x))
    got = ann.search(vectors(spark, x), every=20).toPandas()
    shares = []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        if queries is None or q in queries:
            np.testing.assert_allclose(g.score, (x[g.vec_id] * x[q]).sum(axis=1))
            shares.append(len(set(g.vec_id) & set(exact(x, ids, q))) / 20)
    n = ann.sample_for(len(x))
    router = ann.fit(x[np.random.default_rng(1).permutation(len(x))[:n]], ann.parts_for(len(x)), rows=len(x))
    home = router.routes(x, 1)[:, 0]
    held = np.bincount(home, minlength=len(router.b2))
    return got.query_id.nunique(), np.mean(shares), held[router.routes(x[::20])].sum(axis=1).mean() / len(x)


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(3000, 24)), np.repeat(rng.normal(size=(30, 24)), 50, axis=0) + rng.normal(0, 0.1, (1500, 24)))).astype(np.float32).astype(float)
    n, recall, _ = measured(spark, x)
    assert n == 225 and recall >= 0.9


def test_a_small_part_of_clustered_vectors_is_searched(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 32))[rng.integers(0, 400, 20_000)] + rng.normal(0, 0.4, (20_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    n, recall, share = measured(spark, x, set(range(0, 20_000, 400)))
    assert n == 1000 and recall >= 0.9 and share < 0.2


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = queries.op10_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    place = {i: k for k, i in enumerate(ids)}
    shares = [len(set(g.vec_id) & set(exact(x, ids, place[q]))) / 20 for q, g in got.groupby("query_id")]
    assert len(shares) == (ids % 20 == 0).sum() and np.mean(shares) >= 0.9


def test_ties_and_rows_that_take_no_part(spark):
    x = np.ones((300, 4))
    got = ann.search(vectors(spark, x), every=20).toPandas().sort_values(["query_id", "rank"])
    for q, g in got.groupby("query_id"):
        assert g.vec_id.tolist() == [i for i in range(21) if i != q][:20]
    odd = spark.createDataFrame(
        [(0, [1.0, 2.0], "n", 1), (1, None, "n", 1), (2, [0.0, 0.0], "n", 1), (3, [1.0, None], "n", 1), (4, [float("nan"), 1.0], "n", 1), (5, [float("inf"), 1.0], "n", 1), (6, [3.0, 1.0], "n", 1), (None, [1.0, 1.0], "n", 1), (7, [1.0], "n", 1), (6, [2.0, 9.0], "n", 1), (8, [], "n", 1), (20, [2.0], "n", 1), (40, [3.0, 0.0, 0.0], "n", 1)],
        "vec_id long, embedding array<float>, part string, `a.b` int",
    )
    assert sorted(tuple(r) for r in ann.search(odd, every=20).collect()) == [(0, 1, 6, 20.0), (20, 1, 7, 2.0)]
    assert ann.search(odd.limit(0), every=20).count() == 0


def test_thin_parts_are_made_up_for(spark):
    """Many equal vectors fill one part only; the queries elsewhere still find all they can."""
    rng = np.random.default_rng(9)
    x = np.concatenate((np.tile(rng.normal(size=8), (1500, 1)), rng.normal(size=(500, 8)) * 3))
    got = ann.search(vectors(spark, x), every=20).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 100


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(8, 16)) * 3, 100, axis=0) + rng.normal(0, 0.3, (800, 16))
    part = ann.balanced_parts(ann.neighbour_graph(x, 10), 8)
    assert (np.bincount(part) == 100).all()
    assert (ann.train_router(x, part[:, None], 8).routes(x, 1)[:, 0] == part).mean() > 0.9
    assert [ann.parts_for(n) for n in (0, 1, 63, 64, 2000, 100_000, 10**12)] == [1, 1, 1, 2, 32, 256, 1024]


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "<article>" + "</b>" * 100_000, "<div>" * 50_000 + "<li>x</li>" * 50_000, "<b>" * 100_000 + "<p>x" * 50_000])
def test_malformed_pages_take_linear_time(html):
    began = time.perf_counter()
    html_extract.parse(html)
    assert time.perf_counter() - began < 8  # a walk of the stack for each tag takes minutes


def test_comments_go_and_paragraphs_about_them_stay():
    article = "<article><p class='reply-to-critics'>one two three four</p><p>five six</p><div class='{}'><p>bad</p></div></article>"
    for name in ("comments", "post-comments", "comment-list", "replies", "reply", "x comment y", "comment-12"):
        assert html_extract.main_text(article.format(name)) == "one two three four\nfive six"
    for name in ("comment-count-free", "replying", "commentary", "no-comment-today"):
        assert html_extract.main_text(article.format(name)) == "one two three four\nfive six\nbad"
