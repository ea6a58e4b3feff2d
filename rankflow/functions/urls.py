"""URLs: reversed form, hosts, domains, sites, dates.

The reversed form sorts a site's pages together: scheme letter and port, padded with - to five characters in all after
the letter's place, host labels from the last to the first, each followed by a point, then path and query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FORM = r"^(?i)(http|https)://([^/:?#]+)(?::([0-9]{1,5}))?((?:[/?#].*)?)$"
_MARK = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(url: Column) -> Column:
    """A valid URL's struct of scheme, host (in lower case), port, rest, path, labels, ip (whether the host is one) and turned; null for others.

    The expression is matched once; all that follows reads its parts.
    """
    parts = F.when(~url.contains(_MARK), F.split(F.regexp_replace(url, _FORM, f"$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK, -1))

    def named(p: Column) -> Column:
        get = lambda i: F.get(p, F.lit(i))
        rest = F.when(get(3) == "", "/").when(~get(3).startswith("/"), F.concat(F.lit("/"), get(3))).otherwise(get(3))
        return F.when(F.size(p) == 4, F.struct(F.lower(get(0)).alias("scheme"), F.lower(get(1)).alias("host"), get(2).alias("port"), get(3).alias("rest"), rest.alias("path"), F.split(F.lower(get(1)), r"\.", -1).alias("labels")))

    def checked(s: Column) -> Column:
        labels = s["labels"]
        ip = _is_ip(labels)
        valid = ip | ((F.size(labels) >= 2) & F.forall(labels, lambda x: x != ""))
        return F.struct(*[s[n].alias(n) for n in ("scheme", "host", "port", "rest", "path", "labels")], ip.alias("ip"), valid.alias("valid"))

    return _let(_let(parts, named), checked)


def _of(url: Column, use: Callable[[Column], Column], valid: bool = True) -> Column:
    """use(the parsed URL); null for what is none, and, if so asked, for invalid ones."""
    return _let(_parsed(url), lambda s: F.when(s["valid"] if valid else s["host"].isNotNull(), use(s)))


def host(url: Column) -> Column:
    """The host in lower case; '' for what is no http(s) URL."""
    return F.when(url.isNotNull(), F.coalesce(_of(url, lambda s: s["host"], valid=False), F.lit("")))


def path(url: Column) -> Column:
    """All after host and port, '/' at least."""
    return F.when(url.isNotNull(), F.coalesce(_of(url, lambda s: s["path"], valid=False), F.lit("/")))


def _is_ip(parts: Column) -> Column:
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.rlike("^[0-9]{1,5}$") & (p.try_cast("int") <= 65535), F.lit(False)))


def is_ip(h: Column) -> Column:
    """Four parts, each a number below 65,536."""
    return _is_ip(F.split(h, r"\.", -1))


def is_valid(url: Column) -> Column:
    """An http(s) URL whose host is an IP or has two labels or more, none of them empty."""
    return F.when(url.isNotNull(), F.coalesce(_of(url, lambda s: F.lit(True)), F.lit(False)))


def reverse(url: Column) -> Column:
    """http://www.foo.com:8080/a -> h8080-com.foo.www./a; null for invalid URLs."""
    turned = lambda s: F.concat(F.when(s["ip"], s["host"]).otherwise(F.array_join(F.reverse(s["labels"]), ".")), F.lit("."))
    return _of(url, lambda s: F.concat(F.when(s["scheme"] == "https", "s").otherwise("h"), F.rpad(s["port"], 5, "-"), turned(s), s["path"]))


_TURNED = r"^([hs])([0-9]{0,5})(-*)([^/]*)\.(/.*)$"


def reverse_back(turned: Column) -> Column:
    """The URL of a reversed one; null for anything else."""
    parts = F.when(~turned.contains(_MARK), F.split(F.regexp_replace(turned, _TURNED, f"$1{_MARK}$2{_MARK}$3{_MARK}$4{_MARK}$5"), _MARK, -1))

    def back(p: Column) -> Column:
        get = lambda i: F.get(p, F.lit(i))
        port = F.when(get(1) == "", "").otherwise(F.concat(F.lit(":"), get(1)))
        good = (F.size(p) == 5) & (F.length(get(1)) + F.length(get(2)) == 5)
        return F.when(good, F.concat(F.when(get(0) == "s", "https://").otherwise("http://"), host_back(get(3)), port, get(4)))

    return _let(parts, back)


def host_back(turned_host: Column) -> Column:
    """com.foo.www -> www.foo.com; IPs stay."""
    return _let(F.split(turned_host, r"\.", -1), lambda p: F.when(_is_ip(p), F.array_join(p, ".")).otherwise(F.array_join(F.reverse(p), ".")))


def _domain(s: Column, suffixes: list[str] | tuple[str, ...]) -> Column:
    labels = s["labels"]
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    out = last(2)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        known = [x.lower() for x in suffixes if x.count(".") + 1 == n]
        out = F.when((F.size(labels) > n) & last(n).isin(known), last(n + 1)).otherwise(out)
    return F.when(s["ip"], s["host"]).otherwise(out)


def domain(url: Column, suffixes: list[str] | tuple[str, ...] = ()) -> Column:
    """The registered name: one label more than the longest matching suffix (of two labels or more), else two labels."""
    return _of(url, lambda s: _domain(s, suffixes))


def domain_back(turned_domain: Column) -> Column:
    """h-----com.foo. -> foo.com: the domain or host of a reversed one without its path."""
    return host_back(F.regexp_extract(turned_domain, r"^[hs][0-9]{0,5}-*([^/]*)\.$", 1))


def first_path(url: Column) -> Column:
    """Host and first path segment: http://a.b/c/d -> a.b/c/."""
    return _of(url, lambda s: _let(F.regexp_extract(s["path"], "^/([^/?#]+)/", 1), lambda x: F.when(x == "", F.concat(s["host"], F.lit("/"))).otherwise(F.concat(s["host"], F.lit("/"), x, F.lit("/")))))


def segmented(url: Column, suffixes: list[str] | tuple[str, ...] = ()) -> Column:
    """domain, host_suffix (labels before it), l1_suffix (first path segment), url_suffix (the rest); null for invalid URLs."""

    def made(s: Column) -> Column:
        before = lambda d: F.substring(s["host"], F.lit(1), F.greatest(F.length(s["host"]) - F.length(d) - 1, F.lit(0)))
        rest = lambda x: F.when(x == "", s["path"]).otherwise(F.substring(s["path"], F.length(x) + 2, F.length(s["path"])))
        two = F.struct(_domain(s, suffixes).alias("d"), F.regexp_extract(s["path"], "^/([^/?#]+)/", 1).alias("x"))
        return _let(two, lambda t: F.struct(t["d"].alias("domain"), before(t["d"]).alias("host_suffix"), t["x"].alias("l1_suffix"), rest(t["x"]).alias("url_suffix")))

    return _of(url, made)


def is_home_page(url: Column) -> Column:
    """A valid URL with nothing after the host but a slash."""
    return F.when(url.isNotNull(), F.coalesce(_of(url, lambda s: (s["path"] == "/") & ~s["rest"].contains("#") & ~s["rest"].contains("?")), F.lit(False)))


def is_blog_host(d: Column, names: tuple[str, ...]) -> Column:
    """Whether a domain contains one of the names."""
    out = F.lit(False)
    for n in names:
        out = out | F.lower(d).contains(n)
    return out


def url_date(url: Column, years: tuple[int, ...] = (2011, 2012)) -> Column:
    """yyyymmdd of the only date in a URL without a query; null for none or several.

    A date is one of the years, a separator, a month, the same separator and a day, with no letter or digit around it.
    """
    pattern = r"(?<![0-9A-Za-z])(?:%s)([-._/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z])" % "|".join(map(str, years))
    found = F.regexp_extract_all(url, F.lit(pattern), F.lit(0))
    return F.when((F.size(found) == 1) & ~url.contains("?"), F.regexp_replace(F.get(found, F.lit(0)), "[^0-9]", "").cast("int"))


#: Domains, in reversed form, whose hosts are left out unless they are the www host.
EXCLUDED = (
    "h-----uk.co.immospy.",
    "h-----com.firstareadrom.",
    "h-----cc.co.",
    "h-----us.craigslist-jobs.",
    "h-----com.craigslist-real-estate.",
    "h-----com.coffeerabbit.",
    "h-----com.rentals-craigslist.",
    "h-----com.craigslist-cars.",
)
#: Start of a reversed domain, and what its host suffixes must hold, for personal spaces that are left out.
PERSONAL = ("h-----com.live", "cid-")


def is_excludable(turned_domain: Column, host_suffix: Column) -> Column:
    """Whether a host is left out: by its domain, or as a personal space; never if its suffix is 'www.'."""
    start, mark = PERSONAL
    listed = turned_domain.isin(*EXCLUDED) | (F.lower(turned_domain).startswith(start) & host_suffix.contains(mark))
    return F.coalesce((host_suffix != "www.") & listed, F.lit(False))


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """The distinct entries (url) of a list: trimmed, blank ones dropped, http(s) URLs reversed, others as they are."""
    entry = F.trim(F.col(column))
    turned = F.when(entry.startswith("http"), reverse(entry)).otherwise(entry)
    return lines.where(entry != "").select(turned.alias("url")).where("url IS NOT NULL").distinct()


def site(df: DataFrame, url: str, prefixes: DataFrame, suffixes: list[str] | tuple[str, ...] = (), out: str = "site") -> DataFrame:
    """df with a URL's site: host and first path segment if `prefixes` (column prefix) has them, else the host if it has it, else the domain.

    Prefixes are written with a slash at their end, as first_path() gives them. null for invalid URLs. Two equi-joins, so the
    table of prefixes may have any size.
    """
    known = prefixes.select(F.col("prefix").alias("_p")).where("_p IS NOT NULL").distinct()
    l1, own = first_path(F.col(url)), F.concat(host(F.col(url)), F.lit("/"))
    asked = df.withColumn("_l1", F.when(l1 != own, l1)).withColumn("_host", F.when(host(F.col(url)) != domain(F.col(url), suffixes), own))
    asked = asked.join(known.select(F.col("_p").alias("_by_l1")), F.col("_l1") == F.col("_by_l1"), "left")
    asked = asked.join(known.select(F.col("_p").alias("_by_host")), F.col("_host") == F.col("_by_host"), "left")
    found = F.coalesce("_by_l1", "_by_host", F.concat(domain(F.col(url), suffixes), F.lit("/")))
    return asked.withColumn(out, F.when(is_valid(F.col(url)), found)).drop("_l1", "_host", "_by_l1", "_by_host")
