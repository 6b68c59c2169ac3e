"""Address expressions."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

# Query parameters that track visitors.
TRACKING_PREFIX, TRACKING = "utm_", ("gclid", "fbclid", "mc_cid", "mc_eid")


def netloc_of(url) -> Column:
    """Host with port, lower case; empty without a scheme or host."""
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host_of(url) -> Column:
    """Host without user and port, lower case; empty for anything that is no address."""
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def same_domain(url, base) -> Column:
    return netloc_of(url) == netloc_of(base)


def is_article_url(url, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col(url).contains(p)
    return out


def normalize_url(url) -> Column:
    """The common form, for absolute addresses whose query needs no re-encoding: no fragment, no tracking parameters, no
    closing slash, https where the scheme is missing; the scheme in lower case, everything else as it is."""
    u = F.regexp_replace(col(url), "#.*$", "")
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    scheme, rest = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^?]*)", 1)
    query = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)).otherwise("")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith(TRACKING_PREFIX) & ~name(p).isin(*TRACKING))
    pairs = F.array_join(F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("=")))), "&")
    slashed = F.when(F.instr(rest, "/") == 0, F.concat(rest, F.lit("/"))).otherwise(rest)
    path = F.when(slashed.rlike("^[^/]*/$"), slashed).otherwise(F.regexp_replace(slashed, "/$", ""))
    return F.concat(scheme, F.lit("://"), path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))


def normalize_url_one(url: str | None, base: str | None = None) -> str | None:
    """The exact form of one address, resolved against ``base``, its query re-encoded; null if it can't be read."""
    if url is None:
        return None
    try:
        url = urljoin(base, url) if base else url
        parts = urlsplit(url)
        if not parts.scheme:
            parts = urlsplit("https://" + url)
        pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING and not k.startswith(TRACKING_PREFIX)]
        path = parts.path or "/"
        return urlunsplit((parts.scheme, parts.netloc, path[:-1] if len(path) > 1 and path.endswith("/") else path, urlencode(pairs), ""))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def normalize_url_exact(urls: pd.Series, bases: pd.Series) -> pd.Series:
    """The exact form for any input, against the second column where it isn't null."""
    text = lambda v: v if isinstance(v, str) else None
    return pd.Series([normalize_url_one(text(u), text(b)) for u, b in zip(urls, bases)])
