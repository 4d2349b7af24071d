"""Keys and scalar column functions over addresses, domains, text and numbers.

All of them are JVM expressions; nothing here leaves whole-stage execution for Python
except the two IDNA helpers, which the parsers apply before a host is stored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lists as L

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# --- domains ----------------------------------------------------------------------


def normalize_domain(col: ColumnOrName) -> Column:
    """Trimmed lower-case domain without scheme, one leading ``www.`` and path."""
    text = F.lower(F.trim(F.coalesce(_c(col), F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, "^https://", ""), "^http://", "")
    return F.substring_index(F.regexp_replace(text, r"^www\.", ""), "/", 1)


def bare_domain(col: ColumnOrName) -> Column:
    """Lower-case domain with one leading ``www.`` removed (a prefix, never inside)."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), r"^www\.", "")


#: An ordinary address or bare domain: scheme, any ``www.``, host labels.
_PLAIN_HOST = r"^(?:[a-z][a-z0-9+.\-]*://)?(?:www\.)*([\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)*)(?:[/?#].*)?$"


def host_of(col: ColumnOrName) -> Column:
    """Host of an address or a bare domain; empty string where there is none.

    Ordinary addresses take one pattern; ports, user names, IPv6 and stray dots the rest.
    """
    text = F.trim(F.coalesce(_c(col), F.lit("")))
    return let(
        F.regexp_extract(F.lower(text), _PLAIN_HOST, 1), lambda plain: F.when(plain != "", plain).otherwise(_any_host(text))
    )


def _any_host(text: Column) -> Column:
    bare = F.regexp_replace(text, "^/+", "")
    bare_v6 = F.length(bare) - F.length(F.replace(bare, F.lit(":"))) > 1
    authority = (
        F.when(F.contains(text, F.lit("://")), F.regexp_extract(text, r"^[^:/?#]*://([^/?#]*)", 1))
        .when(bare_v6 & ~F.startswith(bare, F.lit("[")), F.concat(F.lit("["), F.regexp_extract(bare, r"^([^/?#]*)", 1), F.lit("]")))
        .otherwise(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    )
    host = F.regexp_replace(authority, "^.*@", "")
    host = F.when(F.startswith(host, F.lit("[")), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(host, ":.*$", "")
    )
    host = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    return F.regexp_replace(host, r"^(?:www\.)+", "")


def is_ip(host: Column) -> Column:
    return F.contains(host, F.lit(":")) | host.rlike(r"^\d+\.\d+\.\d+\.\d+$")


def registrable_domain(col: ColumnOrName) -> Column:
    """The registered domain of a host: two labels, three under a listed suffix."""

    return let(host_of(col), _registered)


def registered_of(host: Column) -> Column:
    """:func:`registrable_domain` of a host, as :func:`host_of` gives it."""
    return _registered(host)


def _registered(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return (
        F.when((host == "") | is_ip(host), host)
        .when(two.isin(*L.TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(two)
    )


def host_spellings(domain: str) -> tuple[str, ...]:
    """The Unicode and the ASCII spelling of a literal host."""
    text = domain.strip().lower()
    text = text.split("://", 1)[-1].split("/", 1)[0].rsplit("@", 1)[-1].split(":", 1)[0].strip(".")
    while text.startswith("www."):
        text = text[4:]
    return tuple(sorted({_idna(text, "unicode"), _idna(text, "ascii")}))


def domain_matches(url: ColumnOrName, domain: str, mode: str = "site") -> Column:
    """Does the address belong to the literal ``domain``; see :func:`host_matches`."""
    return let(host_of(url), lambda host: host_matches(host, domain, mode))


def host_matches(host: Column, domain: str, mode: str = "site") -> Column:
    """Does a host, as :func:`host_of` gives it, belong to the literal ``domain``.

    ``host``: the same host. ``site``: the same registered domain; where the domain is
    itself a subdomain, only that host and its children. Both spellings of an
    internationalised domain are tried, so the column side needs no decoding.
    """
    if mode not in ("site", "host"):
        raise ValueError("mode is 'site' or 'host'")
    names = [n for n in host_spellings(domain) if n]
    if not names:
        return F.lit(False)
    if mode == "host":
        return host.isin(*names)
    hits = []
    for name in names:
        labels = name.split(".")
        ip = ":" in name or (len(labels) == 4 and all(p.isdigit() for p in labels))
        keep = 3 if ".".join(labels[-2:]) in L.TWO_LABEL_SUFFIXES else 2
        if ip or len(labels) <= keep:
            hits.append(_registered(host) == name)
        else:
            hits.append((host == name) | F.endswith(host, F.lit("." + name)))
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def domain_matches_column(url: ColumnOrName, domain: ColumnOrName, mode: str = "site", spellings: tuple | None = None) -> Column:
    """:func:`domain_matches` for a domain that differs from row to row.

    Both spellings of an internationalised domain are tried. Inside a lambda function, where no
    Python runs, pass the two as columns made by :func:`spellings_of`.
    """
    return host_matches_column(host_of(url), spellings or spellings_of(domain), mode)


def host_matches_column(host: Column, spellings: tuple[Column, Column], mode: str = "site") -> Column:
    """:func:`host_matches` for a domain given by its two spellings in columns."""
    one, two = spellings
    return _matches_host(host, one, mode) | _matches_host(host, two, mode)


def spellings_of(domain: ColumnOrName) -> tuple[Column, Column]:
    """The Unicode and the ASCII spelling of a domain column's hosts."""
    return host_to_unicode(host_of(domain)), host_to_ascii(host_of(domain))


def _matches_host(host: Column, ours: Column, mode: str) -> Column:
    known = (host != "") & (ours != "")
    if mode == "host":
        return known & (host == ours)
    whole_site = _registered(ours) == ours
    return known & F.when(whole_site, _registered(host) == ours).otherwise((host == ours) | F.endswith(host, F.concat(F.lit("."), ours)))


def same_site(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Equal hosts, or one is a child of the other."""
    a = F.regexp_replace(_url_host(_c(left)), r"^www\.", "")
    b = F.regexp_replace(_url_host(_c(right)), r"^www\.", "")
    return (a != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def is_portal(col: ColumnOrName) -> Column:
    """The domain, or one of its parents, is on the list of large platforms."""
    listed = "|".join(p.replace(".", r"\.") for p in L.PORTALS)
    return bare_domain(col).rlike(rf"(?:^|\.)(?:{listed})$")


def is_wizard(title: ColumnOrName, flag: ColumnOrName | None = None) -> Column:
    """The stored flag; where it is absent, the title pattern."""
    by_title = F.coalesce(_c(title), F.lit("")).rlike(L.WIZARD_TITLE)
    return by_title if flag is None else F.coalesce(_c(flag), by_title)


# --- addresses --------------------------------------------------------------------


def _url_host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(authority, "^.*@", "")
    return F.lower(
        F.when(F.startswith(host, F.lit("[")), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(host, ":.*$", "")
        )
    )


def _url_parts(url: Column) -> Column:
    """scheme, host (brackets kept for IPv6), port, path, query of an address."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^//([^/?#]*)", 1), "^.*@", "")
    path_on = F.regexp_replace(rest, r"^//[^/?#]*", "")
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
        host.alias("host"),
        F.regexp_extract(authority, r":(\d+)$", 1).alias("port"),
        F.regexp_extract(path_on, r"^([^?#]*)", 1).alias("path"),
        F.regexp_extract(path_on, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def _joined(p: Column, path: Column, query: Column) -> Column:
    scheme = F.when(p["scheme"] == "", F.lit("http")).otherwise(p["scheme"])
    port = p["port"].try_cast("int")
    plain = port.isNull() | (port == 0) | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    return F.concat(
        scheme,
        F.lit("://"),
        p["host"],
        F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))),
        path,
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def _root_path(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def normalize_url(col: ColumnOrName) -> Column:
    """Lower scheme and host, default port and fragment removed, trailing slash kept."""
    return let(_url_parts(_c(col)), lambda p: _joined(p, _root_path(p["path"]), p["query"]))


# RFC 3986 characters that stay as they are in a path; a query also keeps "?".
_PATH_KEEP = r"A-Za-z0-9\-._~!$&'()*+,;=:@/"


def percent_encode(col: ColumnOrName, keep: str = _PATH_KEEP) -> Column:
    """Percent-encode as a browser sends it; ready ``%XX`` stays (upper-cased)."""

    def encode(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(%[0-9A-Fa-f]{{2}}|[{keep}]+|.)"), F.lit(1))
        return F.array_join(
            F.transform(
                pieces,
                lambda s: F.when(s.rlike("^%[0-9A-Fa-f]{2}$"), F.upper(s))
                .when(s.rlike(rf"^[{keep}]+$"), s)
                .otherwise(F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "%$1")),
            ),
            "",
        )

    text = _c(col)
    return F.when(text.rlike(rf"^[{keep}]*$"), text).otherwise(encode(text))


def percent_decode(col: ColumnOrName) -> Column:
    """Percent-decode; a stray ``%`` and ``+`` stay as they are."""
    text = _c(col)
    guarded = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.url_decode(guarded)).otherwise(text)


def dedup_key(col: ColumnOrName) -> Column:
    """One key per page: normalised, percent-normalised, no trailing slash or campaign marks."""
    marks = "|".join(L.TRACKING_PARAMS)

    def key(p: Column) -> Column:
        path = percent_encode(_root_path(p["path"]))
        path = F.when(path.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
        query = F.array_join(
            F.filter(
                F.split(percent_encode(p["query"], _PATH_KEEP + "?"), "&"),
                lambda pair: (pair != "") & ~pair.rlike(rf"(?i)^(?:{marks})(?:=|$)"),
            ),
            "&",
        )
        return _joined(p, path, query)

    return let(_url_parts(_c(col)), key)


def normalize_path(col: ColumnOrName) -> Column:
    """Lower-case path key shared by sources that name the same page differently."""
    text = F.trim(_c(col))
    path = F.when(text.rlike("^https?://"), F.concat(F.lit("/"), F.regexp_extract(text, r"^https?://[^/]*/?(.*)$", 1))).otherwise(text)
    path = F.regexp_replace(path, r"[?#](?s:.*)$", "")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    path = F.lower(F.regexp_replace(path, "/+$", ""))
    return F.when(F.coalesce(_c(col), F.lit("")) == "", F.lit("")).when(path == "", F.lit("/")).otherwise(path)


def page_path(col: ColumnOrName) -> Column:
    """Path of a page with case and trailing slash kept."""
    text = F.trim(F.coalesce(_c(col), F.lit("")))
    path = F.when(
        F.contains(text, F.lit("://")), F.regexp_extract(text, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    ).otherwise(text)
    path = F.regexp_extract(path, r"^([^?#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def page_key(col: ColumnOrName) -> Column:
    """Comparison key of a page across sources."""
    return normalize_path(page_path(col))


def article_url_key(col: ColumnOrName) -> Column:
    """Host plus decoded path, case of the path kept; no scheme, ``www.``, query or slash."""
    text = F.trim(F.coalesce(_c(col), F.lit("")))
    text = F.when(F.contains(text, F.lit("//")), text).otherwise(F.concat(F.lit("//"), text))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^//([^/?#]*)", 1), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":.*$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return F.concat(host, F.regexp_replace(percent_decode(path), "/+$", ""))


def page_domain(col: ColumnOrName) -> Column:
    return F.substring_index(article_url_key(col), "/", 1)


def crawlable(col: ColumnOrName) -> Column:
    """Worth opening: http(s) or relative, and not a listed file type."""
    url = _c(col)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    extension = F.regexp_extract(path, r"(\.[^.]*)$", 1)
    return scheme.isin("", "http", "https") & ~extension.isin(*L.SKIP_EXTENSIONS)


def url_depth(col: ColumnOrName) -> Column:
    """Number of path segments."""
    path = F.regexp_extract(_c(col), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


# --- text -------------------------------------------------------------------------


def query_words(col: ColumnOrName) -> Column:
    """Words longer than two letters, at least one."""
    words = F.filter(F.split(_c(col), r"(?U)\W+"), lambda w: F.char_length(w) > 2)
    return F.greatest(F.lit(1), F.size(words))


def word_count(col: ColumnOrName) -> Column:
    """Runs of letters, or runs of digits."""
    return F.regexp_count(_c(col), F.lit(r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"))


def slug(col: ColumnOrName) -> Column:
    """Latin slug of a name."""
    single = {k: v for k, v in L.TRANSLIT.items() if len(v) == 1}
    text = F.lower(F.trim(_c(col)))
    for letter, latin in L.TRANSLIT.items():
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    text = F.translate(text, "ъь", "")
    text = F.translate(text, "".join(single), "".join(single.values()))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", F.lit("project")).otherwise(text)


def clean_text(col: ColumnOrName, limit: int = 160) -> Column:
    """One line of foreign text without markup and control characters, cut with an ellipsis."""
    text = F.regexp_replace(
        F.coalesce(_c(col), F.lit("")), r"[`|«»\"<>*“”„\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Cs}\p{Co}\p{Cn}]", " "
    )
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    if not limit:
        return text
    return F.when(
        F.char_length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))
    ).otherwise(text)


def squeezed(col: ColumnOrName) -> Column:
    """Comparison form of a phrase: lower case, trimmed."""
    return F.lower(F.trim(_c(col)))


# --- numbers and times ------------------------------------------------------------


def ctr(clicks: ColumnOrName, shows: ColumnOrName) -> Column:
    """Click-through in percent; NULL where nothing was shown."""
    return F.round(F.lit(100.0) * F.coalesce(_c(clicks), F.lit(0)) / F.nullif(_c(shows), F.lit(0)), 2)


def parse_modtime(col: ColumnOrName) -> Column:
    """``20210729T083812`` to a timestamp; anything else is NULL."""
    return F.try_to_timestamp(F.substring(_c(col), 1, 15), F.lit("yyyyMMdd'T'HHmmss"))


def age_days(ts: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Fractional days between a moment and ``as_of``."""
    return (F.unix_micros(_c(as_of)) - F.unix_micros(_c(ts))) / F.lit(86_400_000_000.0)


def moment(as_of) -> Column:
    """A literal moment from a Column, a datetime or ISO text (read as UTC)."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast(T.TimestampType())


# --- internationalised hosts (the only Python here) -------------------------------


def _idna(host: str, to: str) -> str:
    labels = []
    for label in host.split("."):
        try:
            if to == "unicode" and label.startswith("xn--"):
                label = label.encode("ascii").decode("idna")
            elif to == "ascii" and not label.isascii():
                label = label.encode("idna").decode("ascii")
        except UnicodeError:
            pass
        labels.append(label)
    return ".".join(labels)


@F.pandas_udf(T.StringType())
def host_to_unicode(hosts: pd.Series) -> pd.Series:
    """Punycode labels to Unicode; feed it distinct hosts."""
    return hosts.map(lambda h: _idna(h, "unicode"), na_action="ignore")


@F.pandas_udf(T.StringType())
def host_to_ascii(hosts: pd.Series) -> pd.Series:
    """Unicode labels to punycode; feed it distinct hosts."""
    return hosts.map(lambda h: _idna(h, "ascii"), na_action="ignore")
