import pytest
from pyspark.sql import functions as F

from cueline.functions import text, timecode, urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("time, seconds", [("0:05", 5), ("1:02:03", 3723), ("invalid", 0), ("a:b", None), ("1:2:3:4", 0), ("12abc:07", 727), (None, None)])
def test_parse_seconds(spark, time, seconds):
    assert one(spark, timecode.parse_seconds, time) == seconds


@pytest.mark.parametrize("seconds, label", [(75.0, "1:15"), (3723.9, "1:02:03"), (0.0, "0:00"), (7.9, "0:07"), (None, None)])
def test_label(spark, seconds, label):
    assert one(spark, timecode.label, seconds, "double") == label


@pytest.mark.parametrize("seconds, label", [(75.0, "1:15"), (3723.9, "62:03"), (None, None)])
def test_minutes_label(spark, seconds, label):
    assert one(spark, timecode.minutes_label, seconds, "double") == label


@pytest.mark.parametrize("time, stamp", [("75:05", "01:15:05,000"), ("1:02:03", "01:02:03,000"), ("x", "00:00:00,000"), ("6000:00", "100:00:00,000"), ("123:00:05", "123:00:05,000")])
def test_srt_stamp(spark, time, stamp):
    assert one(spark, timecode.srt_stamp, time) == stamp


@pytest.mark.parametrize("time, out", [("0:58", "01:01"), ("59:58", "60:01"), ("x", "00:03"), ("1:59:58", "02:00:01")])
def test_add_seconds(spark, time, out):
    assert one(spark, lambda c: timecode.add_seconds(c, 3), time) == out


def test_deep_link(spark):
    assert one(spark, lambda c: timecode.deep_link(c, F.lit(7.9)), "u") == "u?t=7s"
    assert one(spark, lambda c: timecode.deep_link(c, F.lit(7.0)), "u?v=1") == "u?v=1&t=7s"


ID = "a-B_c9Xy7z0"
# one address for each rule: hosts, ways to give the id, further parameters, upper case
GOOD = [
    *(f"https://{host}/watch?v={ID}" for host in urls.WATCH_HOSTS), f"https://{urls.SHORT_HOST}/{ID}", f"http://{urls.SHORT_HOST}/{ID}?t=9&x=1",
    f"https://youtube.com/embed/{ID}", f"https://m.youtube.com/v/{ID}", f"https://youtube.com/watch?a=b&v={ID}#here", f"https://YOUTUBE.com/watch?v={ID}",
]
# other host, no id, ids of wrong length or signs, other scheme, no address
BAD = [
    f"https://video.test/watch?v={ID}", "https://youtube.com/watch?x=1", "https://m.youtube.com/watch?v=", f"https://{urls.SHORT_HOST}", f"https://youtube.com/watch?v={ID[:-1]}",
    f"https://youtube.com/watch?v={ID}0", f"https://youtube.com/watch?v={ID[:-1]}*", f"file://youtube.com/watch?v={ID}", f"https://{urls.SHORT_HOST}/{ID}\n", "some words", " ", None,
]


def test_video_urls(spark):
    df = spark.createDataFrame([(u,) for u in GOOD + BAD], "url string")
    rows = df.select("url", urls.is_video_url(F.col("url")).alias("ok"), urls.video_id(F.col("url")).alias("id")).collect()
    assert [r.url for r in rows if r.ok] == GOOD
    assert {r.id for r in rows[: len(GOOD)]} == {ID}


@pytest.mark.parametrize("url, ok", [("https://m.youtube.com/any?list=q", True), (f"https://youtube.com/watch?list=q&v={ID}", True), ("https://youtube.com/any?list=", False), (f"https://youtu.be/{ID}?list=q", False), ("https://video.test/any?list=q", False)])
def test_playlist_urls(spark, url, ok):
    assert one(spark, urls.is_playlist_url, url) is ok


@pytest.mark.parametrize("url, part, page", [("https://www.youtube.com/@name", "@name", "https://www.youtube.com/@name/videos"), ("https://www.youtube.com/channel/UC1/", "channel", "https://www.youtube.com/channel/UC1/videos"), ("https://www.youtube.com/c/x/videos", "c", "https://www.youtube.com/c/x/videos"), ("https://www.youtube.com/@n?a=1", "@n", "https://www.youtube.com/@n/videos?a=1")])
def test_channel_urls(spark, url, part, page):
    assert one(spark, urls.is_channel_url, url) is True
    assert one(spark, urls.channel_identifier, url) == part
    assert one(spark, urls.channel_videos_page, url) == page


def test_loose_url_and_channel_ids(spark):
    assert one(spark, urls.is_loose_video_url, "youtube.com/x") is True
    assert one(spark, urls.is_loose_video_url, "https://example.com/x") is False
    assert one(spark, urls.channel_id, "https://www.youtube.com/channel/UC9") == "UC9"
    assert one(spark, urls.channel_handle, "https://www.youtube.com/@h/x") == "@h"


def test_text(spark):
    assert one(spark, text.trim_all, "\t a b\n ") == "a b"
    assert one(spark, text.ends_sentence, "Yes! \n") is True
    assert one(spark, text.estimated_tokens, "12345") == 2
    assert one(spark, lambda c: text.truncate_to_tokens(c, 1), "12345") == "1234"
    assert one(spark, text.classify_error, "Navigation timeout") == "TIMEOUT"
    assert one(spark, text.classify_error, "Timeout") == "UNKNOWN"
    assert one(spark, text.finish_reason, "max_tokens") == "length"
    assert one(spark, text.model_dimensions, "Xenova/all-mpnet-base-v2") == 768
    assert one(spark, text.context_window, "unknown") == 4096
    assert one(spark, text.error_info, "NO_TRANSCRIPT").title == "No Transcript Available"
    assert one(spark, text.error_info, "x").suggestion is None
