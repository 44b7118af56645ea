"""URL helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: product page forms, and the page that wraps a product url in its query string
_PRODUCT = r"(?:item\.jd\.com|item\.m\.jd\.com/product)/(\d+)\.html"
_SHELL_PAGE = "historylowest.aspx"
_SHELL_PARAM = r"[?&]url=([^&#]+)"
_CANONICAL = "https://item.jd.com/%s.html"


def domain_of(col: Column) -> Column:
    """Host in lower case without one leading `www.`; empty text for a bad url."""
    host = F.lower(F.coalesce(F.try_parse_url(col, F.lit("HOST")), F.lit("")))
    return F.regexp_replace(host, r"^www\.", "")


def norm_product_url(col: Column) -> Column:
    """Canonical product url of a desktop, mobile or wrapped form; null for anything else."""
    inner = F.regexp_extract(col, _SHELL_PARAM, 1)
    wrapped = F.contains(F.lower(col), F.lit(_SHELL_PAGE)) & (inner != "")
    sku = F.regexp_extract(F.when(wrapped, F.try_url_decode(inner)).otherwise(col), _PRODUCT, 1)
    return F.when(sku != "", F.format_string(_CANONICAL, sku))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
