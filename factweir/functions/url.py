"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweir.functions import address


def host_of(url: Column) -> Column:
    """Host, lower-cased, without user, port and a leading `www.`; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, no trailing slash of the path, no fragment."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(path_of(u), "/+$", "")
    query = F.regexp_extract(u, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), query)


def under(host: Column, domain: Column) -> Column:
    """The host is the domain or one of its subdomains."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


_NAMED_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?(?:[/?#]|$)"


def allowed_url(url: Column) -> Column:
    """http or https on its own port to a public name or address: no local names and no addresses that aren't public,
    however they are written. What a name resolves to is checked by `admission`."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host, port = F.lower(F.regexp_extract(url, _NAMED_HOST, 1)), F.regexp_extract(url, _NAMED_HOST, 2)
    local = host.rlike(r"^(localhost|.*[.](local|internal|localhost))$")
    public = F.coalesce(address.is_public(host, loose=True), ~host.startswith("["))
    return scheme.isin("http", "https") & (host != "") & ~local & public & (F.coalesce(port.try_cast("int"), F.when(port == "", 80)).isin(80, 443))


def resolve(base: Column, link: Column) -> Column:
    """The address that a link on a page of address `base` leads to, by RFC 3986, without its fragment.

    The path of a link that names a scheme or a place is left as it is."""
    part = lambda u, i: F.regexp_extract(u, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$", i)
    link, base = F.trim(F.coalesce(link, F.lit(""))), F.coalesce(base, F.lit(""))
    scheme, place, path, query = (part(link, i) for i in (1, 2, 3, 4))
    own, home, here, asked = (part(base, i) for i in (1, 2, 3, 4))
    merged = F.when((home != "") & (here == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(here, "(?s)^(.*/)?", 0), path))
    bare = (scheme == "") & (place == "")
    way = F.when(~bare, path).when(path == "", here).otherwise(_without_dots(F.when(path.startswith("/"), path).otherwise(merged)))
    out = F.concat(
        F.when(scheme == "", F.when(own == "", own).otherwise(F.concat(own, F.lit(":")))).otherwise(F.concat(scheme, F.lit(":"))),
        F.when(bare, home).otherwise(place),
        way,
        F.when(bare & (path == "") & (query == ""), asked).otherwise(query),
    )
    return out


def _without_dots(path: Column) -> Column:
    """Segments `.` go, `..` takes the one before along; a last one of these leaves a slash."""
    segments = F.split(path, "/")
    rooted = path.startswith("/")

    def step(kept: Column, x: Column) -> Column:
        bare = F.size(kept) - F.when(rooted, 1).otherwise(0)
        return F.when(x == ".", kept).when(x == "..", F.when(bare > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ended = F.element_at(segments, -1).isin(".", "..")
    return F.when(~path.contains("."), path).otherwise(F.array_join(F.when(ended, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
