"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a reference that is not fetched, and as a safe scheme.
UNFETCHABLE = ("#", "javascript:", "mailto:", "tel:", "about:", "blob:")
SAFE_SCHEMES = ("", "http", "https", "mailto", "tel")

# Hosts of trackers, matched whole or as a suffix after a dot.
TRACKER_DOMAINS = (
    "google-analytics.com", "googletagmanager.com", "googlesyndication.com", "googleadservices.com", "doubleclick.net",
    "connect.facebook.net", "hotjar.com", "mixpanel.com", "segment.com", "segment.io", "amplitude.com", "clarity.ms",
    "fullstory.com", "mouseflow.com", "crazyegg.com", "matomo.cloud", "stats.wp.com", "scorecardresearch.com",
    "quantserve.com", "js-agent.newrelic.com", "nr-data.net", "widget.intercom.io", "ads-twitter.com",
    "analytics.tiktok.com", "snap.licdn.com", "px.ads.linkedin.com", "mc.yandex.ru", "criteo.com", "criteo.net",
    "taboola.com", "outbrain.com", "addthis.com", "sharethis.com", "plausible.io", "usefathom.com",
)
PIXEL_PATTERNS = ("facebook.com/tr", "google.com/pagead")

# Names that are never public, and IPv4 networks that are not.
LOCAL_NAMES = ("localhost",)
LOCAL_SUFFIXES = (".local", ".internal", ".localhost")
NON_PUBLIC_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port; protocol-relative references have one too."""
    authority = F.regexp_extract(F.lower(F.trim(url)), "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, "^[^@]*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def normalize(url: Column) -> Column:
    """scheme://host/path without a trailing slash, query or fragment."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.concat(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.when(bare == "", "/").otherwise(bare))


def without_dots(path: Column) -> Column:
    """An absolute path without "." and ".." segments: a stack folded over its segments, "..", at the root, taking nothing."""
    names = F.split(path, "/")
    start = F.array(F.lit(""))
    stack = F.aggregate(
        F.slice(names, F.lit(2), F.size(names)), start,
        lambda s, x: F.when(x == "..", F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))),
    )
    stack = F.when(F.element_at(names, -1).isin(".", ".."), F.concat(stack, start)).otherwise(stack)
    joined = F.array_join(stack, "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.when(joined == "", "/").otherwise(joined)).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """ref made absolute against base, without its fragment; dot segments of what is relative are worked off."""
    ref = F.regexp_replace(F.trim(ref), "#.*$", "")
    site = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    directory = F.regexp_extract(path(base), "^(.*/)", 1)
    place, rest = F.regexp_extract(ref, r"^([^?]*)", 1), F.regexp_extract(ref, r"^[^?]*(.*)$", 1)
    below = F.regexp_replace(F.concat(F.when(directory == "", "/").otherwise(directory), place), "/+", "/")
    return (
        F.when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(site, without_dots(place), rest))
        .when(ref.startswith("?"), F.concat(site, path(base), ref))
        .when(ref == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(site, without_dots(below), rest))
    )


def run_key(url: Column) -> Column:
    """Directory name of a run: the host without any "www.", with ":" as "_"."""
    return F.replace(F.replace(netloc(url), F.lit("www."), F.lit("")), F.lit(":"), F.lit("_"))


def safe_run_key(key: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(key, "([^/]*)/*$", 1), "[^A-Za-z0-9._-]", "_")
    name = F.regexp_replace(name, "^[._]+|[._]+$", "")
    return F.when(name == "", "run").otherwise(name)


def template_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def is_unfetchable(ref: Column) -> Column:
    ref = F.lower(F.trim(ref))
    out = F.lit(False)
    for x in UNFETCHABLE:
        out = out | ref.startswith(x)
    return out


def is_safe_uri(uri: Column) -> Column:
    return (uri == "") | scheme(uri).isin(*SAFE_SCHEMES)


def ipv4_number(name: Column) -> Column:
    """The address as a number, or null if the name is no dotted quad."""
    parts = F.split(name, r"\.")
    quad = name.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    value = sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(quad, value)


def is_local_address(name: Column) -> Column:
    """Whether a host name is a dotted quad outside the public networks; null if it is no dotted quad."""
    n = ipv4_number(name)
    out = F.lit(False)
    for network, bits in NON_PUBLIC_IPV4:
        a, b, c, d = map(int, network.split("."))
        size = 1 << (32 - bits)
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | n.between(low, low + size - 1)
    return F.when(n.isNotNull(), out)


def is_local_name(name: Column) -> Column:
    out = name.isin(*LOCAL_NAMES)
    for x in LOCAL_SUFFIXES:
        out = out | name.endswith(x)
    return out


def may_be_public(url: Column) -> Column:
    """http(s) with a host that is neither a local name nor a non-public address; names are not resolved."""
    name = host(url)
    return scheme(url).isin("http", "https") & (name != "") & ~is_local_name(name) & ~F.coalesce(is_local_address(name), F.lit(False))


def is_disallowed_resource(url: Column) -> Column:
    name = host(url)
    return scheme(url).isin("http", "https") & (name != "") & (is_local_name(name) | F.coalesce(is_local_address(name), F.lit(False)))


def is_tracker(url: Column) -> Column:
    lowered, name = F.lower(url), host(url)
    out = F.lit(False)
    for x in PIXEL_PATTERNS:
        out = out | lowered.contains(x)
    return out | F.exists(F.array(*map(F.lit, TRACKER_DOMAINS)), lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))
