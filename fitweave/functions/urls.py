"""URL normalization and admission without name resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave.functions import text as T

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
# fixed values: address blocks that are not globally reachable
PRIVATE_V4 = (
    r"^(?:0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|"
    r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.[02]\.|198\.1[89]\.|"
    r"198\.51\.100\.|203\.0\.113\.|2[45][0-9]\.)"
)
V4 = r"^\d{1,3}(?:\.\d{1,3}){3}$"
PRIVATE_V6 = r"^(?:::1?$|f[cd]|fe[89ab]|2001:db8:|::ffff:)"
LOCAL_NAMES = r"(?:^localhost|\.localhost|\.local|\.internal)$"


def url_parts(url: Column) -> dict[str, Column]:
    text = T.strip(url)
    authority = F.regexp_extract(text, URL, 2)
    address = F.regexp_replace(authority, r"^.*@", "")
    bracketed = address.startswith("[")
    host = F.when(bracketed, F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(address, r"^([^:]*)", 1)
    )
    port = F.regexp_extract(F.regexp_replace(address, r"^\[[^\]]*\]", ""), r":(.*)$", 1)
    return {
        "scheme": F.lower(F.regexp_extract(text, URL, 1)),
        "authority": authority,
        "host": F.lower(host),
        "bracketed": bracketed,
        "port": port,
        "path": F.regexp_extract(text, URL, 3),
        "query": F.regexp_extract(text, URL, 4),
    }


def reject_reason(url: Column) -> Column:
    """Why a URL may not be imported, NULL when it may."""
    p = url_parts(url)
    name = F.regexp_replace(p["host"], r"\.+$", "")
    private = (name.rlike(V4) & name.rlike(PRIVATE_V4)) | (
        p["bracketed"] & name.rlike(PRIVATE_V6)
    )
    return (
        F.when(url.isNull() | ~p["scheme"].isin("http", "https"), "invalid_url_scheme")
        .when((p["port"] != "") & ~p["port"].rlike(r"^\d{1,5}$"), "invalid_url")
        .when(name == "", "invalid_url")
        .when(p["authority"].contains("@"), "url_credentials_forbidden")
        .when(name.rlike(LOCAL_NAMES) | private, "private_network_forbidden")
    )


def normalized_url(url: Column) -> Column:
    p = url_parts(url)
    host = F.when(p["bracketed"], F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"])
    port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"].try_cast("int"))).otherwise("")
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    query = F.when(p["query"] == "?", "").otherwise(p["query"])
    return F.concat(p["scheme"], F.lit("://"), host, port, path, query)
