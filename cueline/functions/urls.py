"""Video, playlist and channel addresses as Columns.  Malformed addresses give null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and the form of a video id.
WATCH_HOSTS = ["www.youtube.com", "youtube.com", "m.youtube.com"]
SHORT_HOST = "youtu.be"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}\z"
LOOSE_URL = r"^(https?:\/\/)?(www\.)?(youtube\.com|youtu\.be)\/.+"
CHANNEL_PATHS = ["/@", "/channel/", "/c/", "/user/"]


def _of(url: Column, part: str, key: str | None = None) -> Column:
    found = F.try_parse_url(url, F.lit(part), F.lit(key)) if key else F.try_parse_url(url, F.lit(part))
    return F.nullif(found, F.lit(""))


def host(url: Column) -> Column:
    return F.lower(_of(url, "HOST"))


def path(url: Column) -> Column:
    return F.coalesce(_of(url, "PATH"), F.lit("/"))


def video_id(url: Column) -> Column:
    """Short host: the path; else the ``v`` parameter, else what follows ``/embed/`` or ``/v/``; null if none."""
    p = path(url)
    short = F.nullif(F.substring(p, 2, 1 << 20), F.lit(""))
    embedded = F.nullif(F.regexp_extract(p, r"^/(?:embed|v)/(.*?)(?:/(?:embed|v)/|$)", 1), F.lit(""))
    return F.when(host(url) == SHORT_HOST, short).when(host(url).isNotNull(), F.coalesce(_of(url, "QUERY", "v"), embedded))


def is_video_url(url: Column) -> Column:
    """http or https, a known host, and an id of 11 letters, digits, ``-`` or ``_``."""
    ok = (
        F.lower(_of(url, "PROTOCOL")).isin("http", "https")
        & host(url).isin(*WATCH_HOSTS, SHORT_HOST)
        & video_id(url).rlike(VIDEO_ID)
    )
    return F.coalesce(ok, F.lit(False))


def playlist_id(url: Column) -> Column:
    return _of(url, "QUERY", "list")


def is_playlist_url(url: Column) -> Column:
    """A known host other than the short one, and a ``list`` parameter that isn't empty; any scheme."""
    return F.coalesce(host(url).isin(*WATCH_HOSTS) & playlist_id(url).isNotNull(), F.lit(False))


def is_channel_url(url: Column) -> Column:
    known = host(url).isin(*WATCH_HOSTS)
    form = F.lit(False)
    for start in CHANNEL_PATHS:
        form = form | F.startswith(path(url), F.lit(start))
    return F.coalesce(known & form, F.lit(False))


def is_loose_video_url(url: Column) -> Column:
    """The tool surface's looser test: scheme and ``www.`` are optional and no id is asked for."""
    return F.coalesce(url.rlike(LOOSE_URL), F.lit(False))


def _path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def channel_identifier(url: Column) -> Column:
    """The first part of the path, be it a handle or just ``channel`` or ``c``."""
    return F.when(host(url).isNotNull(), F.get(_path_parts(url), F.lit(0)))


def channel_id(url: Column) -> Column:
    """The id after ``channel`` or ``c``, or the handle itself; empty if neither."""
    first, second = F.get(_path_parts(url), F.lit(0)), F.get(_path_parts(url), F.lit(1))
    return (
        F.when(first.isin("channel", "c"), F.coalesce(second, F.lit("")))
        .when(F.startswith(first, F.lit("@")), first)
        .otherwise(F.lit(""))
    )


def channel_handle(url: Column) -> Column:
    first = F.get(_path_parts(url), F.lit(0))
    return F.when(F.startswith(first, F.lit("@")), first).otherwise(F.lit(""))


def channel_videos_page(url: Column) -> Column:
    """The channel's page of videos: ``/videos`` is put at the end of the path unless it is there."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.when(base.endswith("/videos"), url).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/videos"), rest))


def watch_url(id_: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), id_)
