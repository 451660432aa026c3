"""URL identity as column expressions. URLs are split by the RFC 3986 pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter prefixes that carry no meaning, host prefixes of the same page,
# and second-level labels under which registrations sit one label deeper.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "s_cid", "cmpid", "spm", "_ga")
SAME_PAGE_HOSTS = ("www.", "m.", "amp.")
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu", "ne", "or", "go")

RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), RFC3986, group)


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scheme(url: Column) -> Column:
    return F.lower(_piece(url, 1))


def authority(url: Column) -> Column:
    return F.lower(_piece(url, 2))


def path(url: Column) -> Column:
    return _piece(url, 3)


def query(url: Column) -> Column:
    return _piece(url, 4)


def host(url: Column) -> Column:
    """Host without credentials, port and ``www.``."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def _stripped_host(url: Column) -> Column:
    out = authority(url)
    for prefix in SAME_PAGE_HOSTS:  # each at most once, in this order
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 10_000)).otherwise(out)
    return out


def _parameters(url: Column) -> Column:
    """Parameters worth keeping, in order."""
    junk = "^(" + "|".join(TRACKING) + ")"
    return F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(p).rlike(junk))


def canonical_url(url: Column) -> Column:
    """One address for a page: no tracking parameters, fragment, closing slash or
    www/m/amp host. Text without a host is returned as it is."""
    kept = _parameters(url)
    trimmed = F.regexp_replace(path(url), "/+$", "")
    built = F.concat(F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url)), F.lit("://"), _stripped_host(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(authority(url) == "", F.coalesce(url, F.lit(""))).otherwise(built)


def url_key(url: Column) -> Column:
    """Grouping key: the canonical URL with https, without default ports, index
    pages and a closing /amp, its parameters in order of name (stable)."""
    return bound(canonical_url(url), _key_of)


def _key_of(canon: Column) -> Column:
    kept = F.filter(F.split(query(canon), "&"), lambda p: p != "")
    numbered = F.transform(kept, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))
    ordered = F.transform(F.array_sort(numbered), lambda s: s["p"])
    bare = F.regexp_replace(F.regexp_replace(path(canon), r"(?i)/(?:index|default)\.(?:html?|php|aspx?)$", ""), "/amp$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    netloc = F.regexp_replace(F.regexp_replace(authority(canon), r"^.*@", ""), r":(80|443)?$", "")
    built = F.concat(F.lit("https://"), netloc, F.when(bare == "", F.lit("/")).otherwise(bare), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise(F.lit("")))
    return F.when(scheme(canon).isin("http", "https") & (netloc != ""), built).otherwise(canon)


def site(host_col: Column) -> Column:
    """The registrable part of a host, by label counts."""
    labels = F.filter(F.split(F.lower(F.coalesce(host_col, F.lit(""))), r"\."), lambda x: x != "")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    take = F.least(F.when(deep, 3).otherwise(2), n)
    return F.array_join(F.slice(labels, F.greatest(n - take + 1, F.lit(1)), F.greatest(take, F.lit(1))), ".")


def host_family(url: Column) -> Column:
    """A host and its www twin, the host first."""
    own = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.array(own, F.when(own.startswith("www."), F.substring(own, 5, 10_000)).otherwise(F.concat(F.lit("www."), own)))


def within(host_col: Column, domain: str) -> Column:
    """Whether a host is a domain or below it; never for an empty host."""
    return (host_col == domain) | host_col.endswith("." + domain)


def landing_path(url: Column) -> Column:
    """A front, section or topic page: no article slug in the path."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return (F.size(segments) == 0) | ((F.size(segments) == 1) & (F.length(F.try_element_at(segments, F.lit(1))) <= 24)) | path(url).contains("/topics/")


def host_suffixes(host_col: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(host_col, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def user_info(url: Column) -> Column:
    """What stands before an @ in the authority; null without one."""
    return F.when(authority(url).contains("@"), F.regexp_extract(authority(url), "^(.*)@", 1))


def bare_host(url: Column) -> Column:
    """Host without credentials and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)$", 1).try_cast("int")


def is_web(url: Column) -> Column:
    """Whether an address could be read at all."""
    return scheme(url).isin("http", "https") & (authority(url) != "")


def _plain(url: Column) -> Column:
    kept = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))
    return F.concat(scheme(url), F.lit("://"), authority(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), kept)


def crawl_url(url: Column) -> Column:
    """The address a crawl knows a page by: its query stays, its fragment goes;
    null for what isn't a web address or carries credentials."""
    return F.when(is_web(url) & (bare_host(url) != "") & user_info(url).isNull(), _plain(url))


# Names of parameters that carry credentials.
SECRETS = ("token", "access_token", "api_key", "apikey", "auth", "authorization", "password", "signature", "sig", "x-amz-signature", "x-amz-credential", "x-goog-signature", "credential")


def corpus_url(url: Column) -> Column:
    """As ``crawl_url``; null also where a parameter is a credential."""
    names = F.transform(F.split(query(url), "&"), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1)))
    return F.when(~F.arrays_overlap(names, F.array(*[F.lit(x) for x in SECRETS])), crawl_url(url))


# Hosts and suffixes of networks that aren't public.
LOCAL_HOSTS, LOCAL_SUFFIXES = ("localhost", "localhost.localdomain"), (".localhost", ".local", ".lan", ".home", ".internal")


def is_public(url: Column) -> Column:
    """Whether an address may be read for a stranger, as far as its text tells: no
    credentials, fragment, odd port, local name or address that isn't global."""
    h = F.regexp_replace(bare_host(url), r"\.$", "")
    part = lambda i: F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b = part(1), part(2)
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    local = h.isin(*LOCAL_HOSTS)
    for suffix in LOCAL_SUFFIXES:
        local = local | h.endswith(suffix)
    return is_web(url) & (h != "") & user_info(url).isNull() & (_piece(url, 5) == "") & F.coalesce(port(url).isin(80, 443), F.lit(True)) & ~local & ~F.coalesce(inner, F.lit(False))


def is_hostname(value: Column) -> Column:
    """Labels of letters, digits and inner dashes, 253 characters at most."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"\.$", "")
    return F.coalesce(plain.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$") & (F.length(plain) <= 253), F.lit(False))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, decoded; '' without one."""
    raw = F.regexp_extract(query(url), f"(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def unwrapped(url: Column) -> Column:
    """The address that a search engine's redirect leads to: a parameter, base64
    behind "a1", or a quoted part of the path; others as they are."""
    h, coded = bare_host(url), parameter(url, "u")
    body = F.translate(F.substring(coded, 3, 1_000_000), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    clicked = parameter(url, "url")
    by_path = F.try_url_decode(F.regexp_extract(url, "/RU=(.*?)(?:/R|$)", 1))
    return (
        F.when(h.isin("www.bing.com", "bing.com") & path(url).startswith("/ck/"), F.when(coded.startswith("a1"), F.coalesce(F.expr("null").cast("string"), F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), F.lit(""))).otherwise(""))
        .when(h.isin("www.bing.com", "bing.com") & clicked.startswith("http"), clicked)
        .when(url.contains("/RU="), by_path)
        .otherwise(url)
    )


def video_id(url: Column) -> Column:
    """The id of a watch page, short link, embed or short; '' for others."""
    h = authority(url)
    watch = F.when(path(url) == "/watch", parameter(url, "v")).otherwise(F.regexp_extract(path(url), "^/(?:embed|shorts|live|v)/([^/]*)", 1))
    found = F.when(h.isin("youtu.be", "www.youtu.be"), F.regexp_extract(path(url), "^/+([^/]*)", 1)).when(h.isin("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"), watch).otherwise("")
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$"), found).otherwise("")


def joined(base: Column, reference: Column) -> Column:
    """A reference on a page as a whole address (absolute, //host, /path, ?query or relative)."""
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    return (
        F.when(F.coalesce(reference, F.lit("")) == "", base)
        .when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme(base), F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(root, reference))
        .when(reference.startswith("?"), F.concat(root, path(base), reference))
        .when(reference.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), reference))
        .otherwise(F.concat(root, folder, F.regexp_replace(reference, r"^(?:\./)+", "")))
    )


def declared_key(url: Column, declared: Column) -> Column:
    """The key of a page's declared address where that is on the same site; null elsewhere."""
    same = lambda whole: F.when(site(bare_host(whole)) == site(bare_host(url)), url_key(whole))
    return F.when((F.coalesce(declared, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != ""), bound(joined(url, declared), same))
