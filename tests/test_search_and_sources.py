"""Search, chat, embeddings, pages, files and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from cueline.operators import chat, chunking, embedding, search
from cueline.sources import files, markup, pages
from cueline.streaming import progress
from tests.fixtures import TRANSCRIPT_A, TRANSCRIPT_B


@pytest.fixture(scope="module")
def store(spark):
    rows = [(v, i, t, x) for v, s in (("A", TRANSCRIPT_A), ("B", TRANSCRIPT_B)) for i, (t, x) in enumerate(s)]
    segments = spark.createDataFrame(rows, "video_id string, idx int, time string, text string")
    made = embedding.embed_transcripts(None, segments, chunking.ChunkingOptions("sentence-based"))
    again = embedding.embed_transcripts(made, segments.where("video_id = 'A'"), chunking.ChunkingOptions("token-based"))
    assert again.groupBy("video_id").count().orderBy("video_id").collect() == [("A", 1), ("B", 10)]
    return made.withColumns({"id": F.col("chunk_id"), "video_url": F.lit("https://youtu.be/x"), "video_title": F.lit("")}).cache()


embed = lambda q: embedding.hashing_embedder()([q])[0].tolist()


def test_search_finds_the_text(store):
    text = TRANSCRIPT_B[3][1]
    hits = search.nearest(store, embed(text), 3, 0.3)
    assert hits.first().text == text and hits.first().score == pytest.approx(1, abs=1e-6)
    assert search.nearest(store, embed(text), 3, filters=search.Filters(video_id="A", start_between=(10, 30))).select("video_id").distinct().count() == 1
    assert search.items(hits).first().video_url_with_timestamp == "https://youtu.be/x?t=25s"
    assert search.result_stats(hits.limit(0)).first().avg_score == 0
    assert search.nearest(store, [0.0] * 384, 3).count() == 0


def test_only_the_needed_columns_are_read(spark, store, tmp_path):
    path = str(tmp_path / "v")
    store.write.parquet(path)
    plan = search.nearest(spark.read.parquet(path), embed("x"), 3, filters=search.Filters(video_id="A")).select("id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(video_id,A)" in plan and "TakeOrderedAndProject" in plan
    assert "metadata" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("bad", [dict(query=" "), dict(query="x" * 1001), dict(query="q", limit=0), dict(query="q", limit=101), dict(query="q", min_score=1.1), dict(query="q", start_between=(5, 5)), dict(query="q", start_between=(-1, None))])
def test_bad_requests(bad):
    with pytest.raises(search.InvalidInput):
        search.SearchRequest(**bad).validate()


def test_good_requests_and_many_queries(store):
    search.SearchRequest("q", min_score=0.0, start_between=(0, 9)).validate()
    asked = store.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    best = search.nearest_many(store, asked, 1)
    assert best.where("id = query_id").count() == store.count()
    # in many blocks as in one, with null and zero vectors left out, and equal ones by id
    odd = store.select("id", "embedding").unionByName(store.select(F.concat(F.lit("~"), "id").alias("id"), "embedding"))
    zero = F.array(*[F.lit(0.0)] * 384).cast("array<float>")
    odd = odd.unionByName(odd.limit(1).select(F.lit("z").alias("id"), zero.alias("embedding"))).unionByName(odd.limit(1).select(F.lit("n").alias("id"), F.lit(None).cast("array<float>").alias("embedding")))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    one, many = rows(search.nearest_many(odd, asked, 4)), rows(search.nearest_many(odd, asked, 4, query_block=3, vector_block=4))
    assert one == many and len(one) == 4 * store.count() and {r[2] for r in one if r[1] == 1} == {r.id for r in store.select("id").collect()}
    for r in asked.limit(2).collect():
        assert [x[2] for x in one if x[0] == r.query_id] == [h.id for h in search.nearest(odd, list(r.query), 4).collect()]
    assert search.nearest_many(odd, asked.limit(0), 4).count() == 0 == search.nearest_many(odd.limit(0), asked, 4).count()


def test_chat(store):
    request = chat.ChatRequest(TRANSCRIPT_B[3][1], max_chunks=2, min_score=0.3, history=[{"role": "user", "content": "before"}])
    seen = []
    parts = list(chat.stream(store, request, embed, lambda m, t: seen.append(m) or "two\nlines"))
    assert [p["type"] for p in parts] == ["status", "sources", "status", "answer", "answer", "complete"]
    assert [m["role"] for m in seen[0]] == ["system", "user", "user"] and seen[0][1]["content"] == "before"
    assert seen[0][2]["content"].startswith("Context from video transcripts:\n\n[Source 1] B at 0:25:\nThey consist")
    assert chat.answer(store, request, embed)["answer"].startswith("They consist of layers")
    assert list(chat.stream(store, chat.ChatRequest(""), embed))[-1]["code"] == "INVALID_INPUT"
    for bad in (dict(query="q" * 2001), dict(query="q", max_chunks=21), dict(query="q", temperature=2.1)):
        with pytest.raises(search.InvalidInput):
            chat.ChatRequest(**bad).validate()


def element(time, text):
    return f'<ytd-transcript-segment-renderer><div class="segment-timestamp"> {time} </div><yt-formatted-string class="segment-text">{text}</yt-formatted-string></ytd-transcript-segment-renderer>'


def test_transcript_pages(spark):
    rows = [
        ("a", "<ytd-transcript-segment-list-renderer>" + element("0:00", "Hi &amp; bye") + element("", "no time") + element("0:05", "") + element("0:09", "end") + "</ytd-transcript-segment-list-renderer>"),
        ("b", "<ytd-transcript-segment-renderer>1:02:03 <b>three parts</b></ytd-transcript-segment-renderer>"),
        ("c", '<ytd-transcript-renderer><div class="cue-group">0:07 other</div><span class="x">0:08 no</span></ytd-transcript-renderer>'), ("d", "<p>none</p>"), ("e", None),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in pages.transcript_segments(df).orderBy("url", "idx").collect()]
    assert got == [("a", 0, "0:00", "Hi & bye"), ("a", 1, "0:09", "end"), ("b", 0, "1:02:03", "three parts"), ("c", 0, "0:07", "other")]
    assert sorted(r.url for r in pages.without_transcript(df).collect()) == ["d", "e"]


def test_nested_and_unclosed_markup():
    one = '<ytd-transcript-segment-renderer class="a > b"><div><div class="x segment-timestamp"><!-- </div> --><span>1:0<b>2</b></span></div></div><p class="segment-text">deep <i>er &lt;b&gt;</i>'
    assert markup.read_transcript(one + "</p></ytd-transcript-segment-renderer>" + one) == [("1:02", "deep er <b>")] * 2
    assert markup.read_transcript(one[:-4] + "<script>if (a < b) '</i>'</script>!") == [("1:02", "deep er <b>!")]
    slot = '<ytd-transcript-segment-renderer><u class="ytd-transcript-segment-renderer" slot=timestamp>0:03</u><yt-formatted-string class="ytd-transcript-segment-renderer">said'
    assert markup.read_transcript(slot) == [("0:03", "said")]
    cue = '<ytd-transcript-segment-renderer><u class="cue-time">0:04</u><div class="cue"><em><yt-formatted-string>heard</em></div>'
    assert markup.read_transcript(cue) == [("0:04", "heard")]
    assert markup.read_transcript("") == markup.read_transcript("<ytd-transcript-segment-renderer") == []


def test_other_containers():
    panel = '<ytd-engagement-panel-section-list-renderer target-id="engagement-panel-transcript">'
    items = "<div class=segments><div class='my-cue'><b class=cue-stamp>0:01</b> one</div><div class=cue>0:02 two<div class=cue>0:03</div></div></div>"
    want = [("0:01", "one"), ("0:02", "two0:03")]
    assert markup.read_transcript(panel + items) == want
    assert markup.read_transcript(panel + "<p class=cue>no time</p></ytd-engagement-panel-section-list-renderer><ytd-transcript-renderer>" + items) == want
    assert markup.read_transcript("<div class=cue>0:09 outside</div><section aria-label='The Transcript'>" + items + "</section>" + items) == want
    assert markup.read_transcript("<ul aria-label=Transcript><li class=cue>0:01 a<li class=cue>1:02:03 b<p>c</ul><p class=cue>0:05 out") == [("0:01", "a"), ("1:02:03", "bc")]
    # a container and its like: only the first of a kind is searched
    assert markup.read_transcript("<ytd-transcript-renderer></ytd-transcript-renderer><ytd-transcript-renderer>" + items) == []


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "</b>" * 100_000, "<!--" * 200_000, "<" * 200_000, "<a " * 200_000, "<a " + "x" * 500_000 + ">", "<a b=\"'>" * 100_000, "<a " + "= " * 200_000 + ">",
     "<ytd-transcript-renderer>" + "<div class=cue>" * 50_000 + "0:01 x", "<ytd-transcript-segment-renderer>0:01 x" * 20_000, "<script>" * 100_000],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    markup.read_transcript(page)
    assert time.process_time() - began < 5  # squares of these sizes take minutes


def test_transcript_rows_in_sql(spark):
    spark.udtf.register("transcript_rows", markup.TranscriptRows)
    df = spark.createDataFrame([(1, element("0:00", "a") + element("0:01", "b")), (2, None), (3, "")], "n int, html string")
    got = spark.sql("SELECT n, r.* FROM {df}, LATERAL transcript_rows(html) r ORDER BY n, idx", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "0:00", "a"), (1, 1, "0:01", "b")]
    got = spark.sql("SELECT n, r.idx FROM {df}, LATERAL transcript_rows(html, true) r ORDER BY n, idx", df=df).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 1), (2, None), (3, None)]


def test_video_lists(spark):
    html = "<title>My &amp; list</title><a href='/watch?v=aaaaaaaaaaa&x=1'></a><a href='/watch?v=bbbbbbbbbbb'></a><a href='/watch?v=aaaaaaaaaaa'></a>"
    r = pages.video_ids(spark.createDataFrame([("https://www.youtube.com/@me/videos", html)], "url string, html string")).first()
    assert (r.title, r.channel_id, r.channel_handle, r.video_ids) == ("My & list", "@me", "@me", ["aaaaaaaaaaa", "bbbbbbbbbbb"])


def test_event_streams(spark):
    lines = ['data: {"text":"a"}', "", ": note", "data: {oops", 'data: {"text":"b"}', "data: [DONE]", 'data: {"text":"late"}']
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "chat string, n int, line string")
    assert [r.event.text for r in files.parse_event_stream(df, "text string", "n", ["chat"]).orderBy("n").collect()] == ["a", "b"]
    assert files.format_event_stream(spark.createDataFrame([("x",)], "text string"), ["text"]).first().value == 'data: {"text":"x"}\n\n'


def test_files(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://youtu.be/a\n\n  \nhttps://youtu.be/b \n")
    assert [r.url for r in files.read_addresses(spark, str(tmp_path / "urls.txt")).orderBy("ord").collect()] == ["https://youtu.be/a", "https://youtu.be/b"]
    (tmp_path / "r.json").write_text('{"a": 1}\n')
    made = files.read_json(spark, str(tmp_path / "r.json"), "a int")
    assert spark.read.parquet(files.replace(made, str(tmp_path / "t"))).first().a == 1
    files.export(spark.createDataFrame([("one",)], "srt string"), "srt", str(tmp_path / "srt"))
    files.export_json(made, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().a == 1
    assert files.report("R", made) == "# R\n\n| a |\n|---|\n| 1 |\n"
    with pytest.raises(ValueError):
        files.report("R", spark.range(5), 4)


def _events(tmp_path):
    rows = [("j", 1, "processing", 1), ("j", 2, "completed", 2), ("j", 3, "processing", 3), ("k", 1, "processing", 1)]
    out = tmp_path / "in"
    out.mkdir()
    for i, (job, seq, status, done) in enumerate(rows):
        event = dict(job_id=job, seq=seq, at=f"2025-01-01T00:00:0{i}Z", status=status, done=done, total=2, video_id="v", message=None)
        (out / f"{i}.json").write_text(json.dumps(event))
    return str(out)


def _run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_progress(spark, tmp_path):
    path = _events(tmp_path)
    last = _run(progress.latest(progress.read_progress(spark, path)), "latest_states", "complete", tmp_path)
    assert {(r.job_id, r.status, r.done) for r in last.collect()} == {("j", "processing", 3), ("k", "processing", 1)}
    clients = spark.createDataFrame([("c1", "j"), ("c2", "j")], "client_id string, job_id string")
    assert _run(progress.route(progress.read_progress(spark, path), clients), "routed", "append", tmp_path).count() == 6


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    path = "/root/testdata/sf0.01/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "e").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    got = _run(progress.request_windows(stream, "user_id", "ts", 3600), "windows", "complete", tmp_path)
    want = progress.request_windows(batch, "user_id", "ts", 3600)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert progress.sliding(batch, "ts", "event_type", 600, 300).agg(F.sum("n")).first()[0] == 2 * batch.count()
    assert progress.sessions(batch, "ts", "user_id", 600).agg(F.sum("n")).first()[0] == batch.count()
