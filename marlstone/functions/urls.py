"""Addresses: canonical form, resolution, safety; pandas UDFs where SQL has no equal."""

from __future__ import annotations

import ipaddress
import posixpath
import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import strip_contacts

#: Names that never lead to a public host, and reserved address blocks.
INTERNAL = ("localhost", "local", "internal", "home", "lan", "test", "invalid")
RESERVED = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "64:ff9b::/96", "100::/64", "2001:db8::/32")]
_BAD_ESCAPE = re.compile("%(?![0-9A-Fa-f]{2})")


def canonical_url(raw: str | None) -> str | None:
    """http and https only, no user part; lower scheme and host, no default port or fragment, dot segments removed."""
    try:
        p = urllib.parse.urlsplit(raw or "")
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return None
    if p.scheme not in ("http", "https") or not host or "@" in p.netloc or _BAD_ESCAPE.search(p.path):
        return None
    if (p.scheme, port) in (("http", 80), ("https", 443)):
        port = None
    host = f"[{host}]" if ":" in host else host
    path = p.path
    if path:
        clean = posixpath.normpath(re.sub("/+", "/", path))
        path = clean + "/" * (path.endswith("/") and clean != "/")
    return urllib.parse.urlunsplit((p.scheme, host + (f":{port}" if port else ""), path, p.query, ""))


def candidate_url(raw: str | None) -> str | None:
    """As `canonical_url`, but the decoded path is cleaned and written again, an empty query stays, and a host that is
    local or no public address gives null."""
    raw = (raw or "").strip()
    try:
        p = urllib.parse.urlsplit(raw)
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return None
    if p.scheme not in ("http", "https") or not host or "@" in p.netloc or _BAD_ESCAPE.search(p.path) or host == "localhost" or host.endswith(".localhost"):
        return None
    try:
        ip = ipaddress.ip_address(host)
        if blocked_ip(host) or str(ip) == "255.255.255.255":
            return None
    except ValueError:
        pass
    if (p.scheme, port) in (("http", 80), ("https", 443)):
        port = None
    path = urllib.parse.unquote(p.path, errors="surrogateescape")
    if path:
        clean = posixpath.normpath(re.sub("/+", "/", path))
        path = urllib.parse.quote(clean + "/" * (path.endswith("/") and clean != "/"), safe="$&+,/:;=@", errors="surrogateescape")
    bare = raw.split("#", 1)[0]
    host = f"[{host}]" if ":" in host else host
    return f"{p.scheme}://{host}{f':{port}' if port else ''}{path}" + ("?" + p.query if p.query or bare.endswith("?") else "")


def allowed_url(raw: str | None) -> bool:
    """Whether an address may be fetched: canonical, and neither an internal name nor a private or reserved address."""
    url = canonical_url(raw)
    if url is None:
        return False
    host = urllib.parse.urlsplit(url).hostname.rstrip(".")
    if any(host == s or host.endswith("." + s) for s in INTERNAL):
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return host != ""
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified or any(ip in n for n in RESERVED if n.version == ip.version))


def blocked_ip(raw: str | None) -> bool:
    try:
        ip = ipaddress.ip_address(raw or "")
    except ValueError:
        return True
    return ip.is_loopback or ip.is_unspecified or ip.is_link_local or ip.is_multicast or _site_local(ip)


def _site_local(ip) -> bool:
    nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")
    return any(ip in ipaddress.ip_network(n) for n in nets if ipaddress.ip_network(n).version == ip.version)


def client_key(raw: str | None) -> str | None:
    """An IPv4 client as it is, an IPv6 one by its /64."""
    try:
        ip = ipaddress.ip_address(raw or "")
    except ValueError:
        return None
    return str(ip) if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False))


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return run


def canonicalize(c: Column) -> Column:
    return _udf(canonical_url, "string")(c)


def candidate(c: Column) -> Column:
    """The canonical address of a candidate; null also where it looks like a mail address or telephone number."""
    return F.when(strip_contacts(F.trim(c)) == F.trim(c), _udf(candidate_url, "string")(c))


def is_allowed(c: Column) -> Column:
    return _udf(allowed_url, "boolean")(c)


def is_blocked_ip(c: Column) -> Column:
    return _udf(blocked_ip, "boolean")(c)


def to_client_key(c: Column) -> Column:
    return _udf(client_key, "string")(c)


def resolved(base: str | None, link: str | None) -> str | None:
    try:
        u = urllib.parse.urljoin(base or "", (link or "").strip())
        p = urllib.parse.urlsplit(u)
        return u if p.scheme in ("http", "https") and p.netloc else None
    except ValueError:
        return None


def resolve(base: Column, link: Column) -> Column:
    """The http(s) address that a link names on a page; null if it names none."""

    @F.pandas_udf("string")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([resolved(x, y) for x, y in zip(b, h, strict=True)])

    return run(base, link)


def resolve_all(base: Column, links: Column) -> Column:
    """The same for each of a page's links; an empty link names nothing."""

    @F.pandas_udf("array<string>")
    def run(b: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([[resolved(x, y) if y and y.strip() else None for y in (() if h is None else h)] for x, h in zip(b, hs, strict=True)])

    return run(base, links)


def host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def slug(c: Column) -> Column:
    """The last path segment that isn't empty."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def bare(c: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(c, "[?#].*$", "")


def media_type(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def origin(c: Column) -> Column:
    return F.regexp_extract(c, "^(https?://[^/?#]+)", 1)
