"""URLs, platforms and handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a lower-cased url contains if it is of a platform, in the order of detection (fixed values).
PLATFORMS = {
    "instagram": ("instagram.com",),
    "twitter": ("twitter.com", "x.com/"),
    "reddit": ("reddit.com",),
    "facebook": ("facebook.com",),
    "tiktok": ("tiktok.com",),
    "bluesky": ("bsky.app",),
}
#: Query parameters that only track (fixed values).
TRACKING = ("_dt", "fbclid", "gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "modal", "ref", "si", "source", "mc_cid", "mc_eid")
#: Domains of each channel (fixed values); all else is press.
SOCIAL = ("reddit.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "nextdoor.com", "threads.net", "mastodon.social", "bsky.app", "linkedin.com")
DIRECT_ACTION = ("gofundme.com", "eventbrite.com", "volunteermatch.org", "change.org", "givemn.org", "givebutter.com", "actionnetwork.org", "mobilize.us", "signupgenius.com")
COMMUNITY = ("patch.com", "swnewsmedia.com", "southwestjournal.com", "tcdailyplanet.net")
ASSETS = r"\.(?:css|js|png|jpg|jpeg|gif|svg|woff|woff2|ico|webp|mp3|mp4)$"


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def domain(url: Column) -> Column:
    """What is between :// and the next slash, in lower case; port and user stay."""
    return F.lower(F.split_part(F.element_at(F.split(url, "://"), -1), F.lit("/"), F.lit(1)))


def parsed_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def platform(url: Column) -> Column:
    """The platform of a url, ``web`` if none."""
    lower, out = F.lower(url), F.lit("web")
    for name, parts in reversed(PLATFORMS.items()):
        out = F.when(contains_any(lower, parts), name).otherwise(out)
    return out


def channel(url: Column) -> Column:
    """social, direct_action, community_media or press, the first that fits."""
    lower = F.lower(url)
    host = domain(lower)
    community = contains_any(lower, ("/feed", "/rss", ".rss")) | contains_any(host, COMMUNITY)
    return F.when(contains_any(host, SOCIAL), "social").when(contains_any(host, DIRECT_ACTION), "direct_action").when(community, "community_media").otherwise("press")


def sanitized(url: Column) -> Column:
    """With a scheme, without tracking parameters and without an empty query; the fragment stays."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    fragment = F.regexp_extract(whole, r"(#.*)$", 1)
    base = F.regexp_replace(whole, r"#.*$", "")
    path = F.split_part(base, F.lit("?"), F.lit(1))
    query = F.when(base.contains("?"), F.regexp_extract(base, r"\?(.*)$", 1)).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING))
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), fragment)


def normalized(url: Column) -> Column:
    """Without scheme, www. and a last slash; twitter.com as x.com."""
    out = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^www\.", "")
    out = F.regexp_replace(out, r"/+$", "")
    return F.regexp_replace(out, r"^twitter\.com", "x.com")


def crawl_normalized(url: Column) -> Column:
    """Without fragment and without one last slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def handle(url: Column) -> Column:
    """The account that a url names: the part after /r/ or /user/ in reddit, else the last segment."""
    sub, user = (F.regexp_extract(url, f"/{p}/([^/]*)", 1) for p in ("r", "user"))
    return F.when((platform(url) == "reddit") & (sub != ""), sub).when((platform(url) == "reddit") & (user != ""), user).otherwise(F.regexp_replace(last_segment(url), "^@+", ""))


def is_web_query(value: Column) -> Column:
    return ~(value.startswith("http://") | value.startswith("https://"))


def canonical(value: Column) -> Column:
    """A source's value: query text as it is, the platform's host and account for four platforms, else the url."""
    lower = F.lower(value)
    sub = F.regexp_extract(value, "/r/([^/]*)", 1)
    account = F.regexp_replace(last_segment(value), "^@+", "")
    return (
        F.when(is_web_query(value), value)
        .when(lower.contains("instagram.com"), F.concat(F.lit("instagram.com/"), last_segment(value)))
        .when(lower.contains("reddit.com") & value.contains("/r/"), F.concat(F.lit("reddit.com/r/"), sub))
        .when(lower.contains("tiktok.com"), F.concat(F.lit("tiktok.com/"), account))
        .when(lower.contains("twitter.com") | lower.contains("x.com"), F.concat(F.lit("x.com/"), account))
        .otherwise(value)
    )


def strategy(value: Column) -> Column:
    """How a source is scraped: web_query, social, html_listing, rss or web_page."""
    lower = F.lower(value)
    social = contains_any(lower, tuple(host for hosts in PLATFORMS.values() for host in hosts))
    listing = (lower.contains("eventbrite.com") & lower.contains("/d/")) | (lower.contains("volunteermatch.org") & lower.contains("/search"))
    feed = contains_any(lower, ("/feed", "/rss", "/atom")) | lower.endswith(".rss") | lower.endswith(".xml")
    return F.when(is_web_query(value), "web_query").when(social, "social").when(listing, "html_listing").when(feed, "rss").otherwise("web_page")


def promotable(link: Column) -> Column:
    """Whether a link may become a source: web, no asset, no script or mail."""
    link = F.trim(link)
    return link.rlike("^https?://") & ~F.lower(F.split_part(link, F.lit("?"), F.lit(1))).rlike(ASSETS)


def same_host(a: Column, b: Column) -> Column:
    return parsed_host(a) == parsed_host(b)


def crawlable(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Substrings of the path: an excluded one wins, no included ones means all."""
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    out = F.lit(not include)
    for s in include:
        out = out | path.contains(s)
    for s in exclude:
        out = out & ~path.contains(s)
    return out


def export_link(url: Column) -> Column:
    """The text export of a shared document's edit link."""
    return F.regexp_replace(url, r"(docs\.google\.com/document/d/[^/?#]+).*$", "$1/export?format=txt")


def entity(url: Column, mapping: list[tuple[str, str]]) -> Column:
    """The entity of the first mapped text that a url contains, else its domain."""
    out = domain(url)
    for part, name in reversed(mapping):
        out = F.when(url.contains(part), name).otherwise(out)
    return out


def source_label(value: Column) -> Column:
    return F.when(is_web_query(value), "search").otherwise(F.regexp_replace(domain(value), r"^www\.", ""))


def owned(value: Column) -> Column:
    """Whether a source is an account in a social network, whose posts are its owner's; feeds and queries gather many authors."""
    return strategy(value) == "social"


def reddit_name(link: Column) -> Column:
    """The name after a ``user`` or ``u`` segment; null if there is none."""
    return F.nullif(F.regexp_extract(link, "(?:^|/)u(?:ser)?/([^/]+)", 1), F.lit(""))


def post_link(uri: Column, handle: Column) -> Column:
    """A post's permanent link from its address ``at://author/collection/key`` and its author's handle."""
    return F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), F.substring_index(uri, "/", -1))
