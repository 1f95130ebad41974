"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import strip

# Query parameters that only track where a reader came from.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid igshid ref source from at_medium at_campaign".split()
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def guarded(link: Column) -> Column:
    """Links of other schemes than http and https become empty."""
    return F.when(link.rlike("^https?://"), link).otherwise("")


def _decoded(c: Column) -> Column:
    """A part of a query without percent signs and plus; one that is no valid encoding stays as it is but for plus."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(link: Column) -> Column:
    """For comparison: without tracking parameters, fragment and slashes at the path's end; the other parameters stay, in order, all encoded alike."""
    u = strip(F.coalesce(link, F.lit("")))
    part = lambda k: F.regexp_extract(u, _URL, k)
    scheme, host, path = part(1), part(2), F.regexp_replace(part(3), "/+$", "")
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def base_path(url: Column) -> Column:
    """The path of a URL without slashes at its end."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3), "/+$", "")


def joined(base: Column, relative: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(relative, "^/+", ""))
