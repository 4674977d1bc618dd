"""Column functions on addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """Host in lower case without user, port and a leading ``www.`` or ``m.``; '' for a null or blank address."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1)
    return F.regexp_replace(host, r"^(?:www|m)\.", "")
