"""What a pasted link is, by an ordered table of rules over its host, path and query; the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, since they are the names of public sites: (kind, platform, host, path, query), regular expressions that must each find something; "" finds everything.
#: `www.` and `m.` are off the host.  The order matters: music before video, episodes before shows, folders before files, single videos before channels.
RULES = (
    ("music", "youtube", r"^music\.youtube\.com$", "", ""),
    ("music", "apple", r"^music\.apple\.com$", "", ""),
    ("music", "soundcloud", r"^soundcloud\.com$", "", ""),
    ("music", "bandcamp", r"\.bandcamp\.com$", "", ""),
    ("music", "other", r"^(tidal|deezer)\.com$", "", ""),
    ("music", "spotify", r"^open\.spotify\.com$", r"^/(track|album|playlist|artist)(/|$)", ""),
    ("long", "spotify", r"^open\.spotify\.com$", r"^/(episode|show)(/|$)", ""),
    ("long", "apple-podcasts", r"^podcasts\.apple\.com$", "", r"(^|&)i=[0-9]"),
    ("feed", "apple-podcasts", r"^podcasts\.apple\.com$", "", ""),
    ("feed", "rss", "", r"(\.rss|/rss/?|/feed/?|\.xml)$", ""),
    ("feed", "rss", r"^(rss|\w*feeds?)\.", "", ""),
    ("long", "podcast", r"^(overcast\.fm|pca\.st|castbox\.fm|pocketcasts\.com|anchor\.fm)$", "", ""),
    ("long", "podcast", r"(^|\.)(podbean|buzzsprout|simplecast|transistor|libsyn|megaphone)\.(com|fm)$", "", ""),
    ("long", "podcast", "", r"/podcast", ""),
    ("product", "store", r"^(apps\.apple\.com|chromewebstore\.google\.com|apps\.microsoft\.com)$", "", ""),
    ("product", "store", r"^microsoft\.com$", r"/store/", ""),
    ("product", "store", r"^play\.google\.com$", r"^/store/apps", ""),
    ("unsupported", "drive", r"^(drive|docs)\.google\.com$", r"/folders(/|$)", ""),
    ("own", "drive", r"^(drive|docs)\.google\.com$", r"/d/[^/]+", ""),
    ("own", "drive", r"^drive\.google\.com$", "", r"(^|&)id=[^&]"),
    ("unsupported", "drive", r"^(drive|docs)\.google\.com$", "", ""),
    ("unsupported", "dropbox", r"^dropbox\.com$", r"^/(scl/fo|sh)(/|$)", ""),
    ("own", "dropbox", r"^(dropbox\.com|dl\.dropboxusercontent\.com)$", "", ""),
    ("own", "onedrive", r"^(1drv\.ms|onedrive\.live\.com)$|\.sharepoint\.com$", "", ""),
    ("unsupported", "icloud", r"(^|\.)icloud\.com$", "", ""),
    ("video", "youtube", r"^youtu\.be$", r"^/[^/]+", ""),
    ("video", "youtube", r"^youtube(-nocookie)?\.com$", r"^/watch(/|$)", r"(^|&)v=[^&]"),
    ("video", "youtube", r"^youtube(-nocookie)?\.com$", r"^/(shorts|live|embed|v)/[^/]+", ""),
    ("ask", "youtube", r"^youtube\.com$", r"^/playlist(/|$)", ""),
    ("ask", "youtube", r"^youtube\.com$", "", r"(^|&)list="),
    ("creator", "youtube", r"^youtube\.com$", r"^/(@[^/]+|(channel|c|user)/[^/]+)", ""),
    ("video", "tiktok", r"^v[mt]\.tiktok\.com$", "", ""),
    ("video", "tiktok", r"(^|\.)tiktok\.com$", r"^/(t/|@[^/]+/video/[^/]+)", ""),
    ("creator", "tiktok", r"(^|\.)tiktok\.com$", r"^/@[^/]+", ""),
    ("unsupported", "instagram", r"^instagram\.com$", r"^/stories(/|$)", ""),
    ("video", "instagram", r"^instagr(am\.com|\.am)$", r"/(reels?|p|tv)/[^/]+", ""),
    ("creator", "instagram", r"^instagram\.com$", r"^/[^/]+", ""),
    ("video", "x", r"^(x|twitter|mobile\.twitter)\.com$", r"^/[^/]+/status/[^/]+", ""),
    ("unsupported", "x", r"^(x|twitter|mobile\.twitter)\.com$", r"^/[^/]+", ""),
    ("video", "other", r"^((player\.)?vimeo|loom|(clips\.)?twitch|rumble|dailymotion|streamable)\.(com|tv)$", "", ""),
    ("video", "other", r"^(facebook|linkedin)\.com$", r"/(watch|videos?|reel|posts)(/|$)", ""),
    ("own", "file", "", r"(?i)\.(mp4|mov|mkv|webm|m4v)$", ""),
    ("ask", "file", "", r"(?i)\.(mp3|m4a|wav|flac|ogg)$", ""),
)
#: What the name of a thing is made of, by kind and platform: which part of the path (from the end), or a name in the query.
NAMED_BY = {"youtube": "v", "apple-podcasts": "i"}


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (small, without port, www. and m.), path and query."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(host, r"^m\.", ""), path, F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def rule_of(host: Column, path: Column, query: Column) -> Column:
    """The number of the first rule that fits, from 0; null if none does."""
    return F.coalesce(*[F.when(F.expr("true") if not (h or p or q) else _all([(host, h), (path, p), (query, q)]), F.lit(k)) for k, (_, _, h, p, q) in enumerate(RULES)])


def _all(tests: list[tuple[Column, str]]) -> Column:
    found = F.lit(True)
    for column, pattern in tests:
        found = found & column.rlike(pattern) if pattern else found
    return found
