"""Which addresses a crawler may visit, as column expressions over parsed URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kbspark import constants as K
from kbspark.functions.text import bind

# IPv4 networks that are not globally routable (first, last address).
PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
# IPv6 text forms that are globally routable, and the local or
# documentation ranges among them. Everything else is loopback, local or reserved.
ROUTABLE_V6 = r"^([23][0-9a-f]{3}:|ff[0-9a-f]{2}:|fe[c-f][0-9a-f]:)"
LOCAL_V6 = r"^2001:(db8:|:|0*1?[0-9a-f]{1,2}:)"
V4_PATTERN = r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(url: Column) -> Column:
    """Lower-cased host without user info, port and brackets; '' when absent."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(host_port.startswith("["), v6).otherwise(F.substring_index(host_port, ":", 1)))


def ipv4_number(host: Column) -> Column:
    """Address as a number; null when the text is not a dotted quad."""
    def number(parts):
        value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
        return F.when(F.array_max(parts) <= 255, value)

    quads = F.transform(F.split(host, r"\."), lambda p: p.try_cast("bigint"))
    return F.when(host.rlike(V4_PATTERN), bind(quads, number))


def _number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_non_public_ip(ip: Column) -> Column:
    """True for a literal private, loopback, reserved or link-local address."""
    def listed(n):
        ranges = F.lit(False)
        for first, last in PRIVATE_V4:
            ranges = ranges | n.between(_number(first), _number(last))
        return ranges

    v6 = F.lower(ip)
    local_v6 = ip.contains(":") & (~v6.rlike(ROUTABLE_V6) | v6.rlike(LOCAL_V6))
    return F.coalesce(bind(ipv4_number(ip), listed), F.lit(False)) | local_v6


def is_safe_url(url: Column, allowed_domains=None) -> Column:
    def host_ok(host):
        ok = (host != "") & ~is_non_public_ip(host)
        if allowed_domains:
            suffix = F.lit(False)
            for d in allowed_domains:
                suffix = suffix | host.endswith(d)
            ok = ok & suffix
        return ok

    return F.coalesce(url_scheme(url).isin("http", "https") & bind(url_host(url), host_ok), F.lit(False))


def is_public_host(url: Column, resolved_ips: Column) -> Column:
    """Host is not on the block list and every address it resolves to is public.
    A host that did not resolve (null) is refused."""
    open_host = bind(url_host(url), lambda host: (host != "") & ~host.isin(*K.BLOCKED_HOSTS))
    return F.coalesce(open_host & ~F.exists(resolved_ips, is_non_public_ip), F.lit(False))


def is_admitted_page(content_length: Column, redirects: Column, content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return (
        (F.coalesce(content_length, F.lit(0)) <= K.PAGE_MAX_BYTES)
        & (F.coalesce(redirects, F.lit(0)) <= K.PAGE_MAX_REDIRECTS)
        & (kind.startswith("text/") | kind.contains("html"))
    )
