"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """Lower-cased host and path: no scheme, leading ``www.`` or ``m.``, query, fragment or trailing slash."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", "")
    bare = F.regexp_replace(bare, r"^(www|m)\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def url_domain(url: Column) -> Column:
    return F.regexp_extract(normalize_url(url), r"^([^/]+)", 1)
