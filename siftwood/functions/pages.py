"""What a page, a read or an answer is: classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import signals, urls

# What challenge pages say, and the marks of those who serve them.
VENDORS = (
    ("cloudflare", ("cf-challenge", "cf-chl-", "challenge-platform", "just a moment")),
    ("datadome", ("datadome", "captcha-delivery.com", "ddm-")),
    ("perimeterx", ("px-captcha", "captcha.px-cdn.net", "press & hold")),
    ("akamai", ("sec-if-cpt-container", "reference #")),
    ("imperva", ("incapsula", "_incap_", "incident id")),
)
PROMPTS = (
    "verification required",
    "prove your humanity",
    "please wait while we verify",
    "verify you are human",
    "verifying you are human",
    "performing security verification",
    "checking your browser",
    "enable javascript and cookies to continue",
    "enable js and disable any ad blocker",
    "complete the security check",
    "we must verify your session before you can proceed",
    "access to this page has been denied",
    "press & hold",
    "verifying your request",
)
CHALLENGE_TITLES = ("just a moment", "verification required", "security check")
BLOCK_PHRASES = (
    "our systems have detected unusual traffic from your computer network",
    "detected unusual activity from your computer network",
    "click the button below to continue shopping",
)
# Marks of pages that scripts build.
APP_MARKS = r"(?i)id=[\"'](?:root|app|__next|__nuxt|svelte|main-app)[\"']|data-reactroot|ng-version|__NEXT_DATA__|__NUXT__|window\.__[A-Z_]+__\s*=|<noscript\b|<iframe\b"


def _any(flags) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def challenge(title: Column, visible: Column, html: Column) -> Column:
    """Who keeps a reader from a page ('' for nobody): a vendor, or generic.

    A brief page counts whose title or first words ask for a check, or that has
    a vendor's marks, a captcha and a prompt.
    """
    t, v, low = folded(title), folded(visible), F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 30_000))
    brief = F.length(v) < 1000
    prompted = _any(v.contains(p) for p in PROMPTS)
    opens = _any(v.startswith(p) for p in PROMPTS)
    titled = _any(t.startswith(p) for p in CHALLENGE_TITLES)
    active = low.rlike(r"<(?:script|iframe)[^>]+(?:captcha|orchestrate|anomaly)|(?:id|class)=[\"'][^\"']*captcha")
    out = F.when(brief & (titled | opens), "generic").when((F.length(v) < 2000) & _any(v.contains(p) for p in BLOCK_PHRASES), "generic").when(brief & (low.contains("anomaly.js") | low.contains('id="px-captcha"')), "generic").otherwise("")
    for vendor, marks in reversed(VENDORS):
        out = F.when(brief & _any(low.contains(m) for m in marks) & (titled | opens | (active & prompted)), vendor).otherwise(out)
    return out


def is_shell(tier: Column, text_chars: Column, html_chars: Column) -> Column:
    """Much markup and little text, by a tier that another may follow."""
    floor = F.when(tier == "render", 1200).otherwise(2048)
    return tier.isin("direct", "tls", "render") & (text_chars > 0) & (text_chars < floor) & (html_chars >= 20 * text_chars)


def is_static(html: Column, text_chars: Column) -> Column:
    """No sign that scripts build the page: no app marks, few scripts, little markup."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b(?![^>]*\bsrc=)[^>]*>(.*?)</script>"), F.lit(1))
    inline = F.aggregate(scripts, F.lit(0), lambda n, s: n + F.length(s))
    external = F.regexp_count(html, F.lit(r"(?i)<script\b[^>]*\bsrc="))
    return F.coalesce((F.length(html) > 0) & (F.length(html) <= 300_000) & ~html.rlike(APP_MARKS) & (external <= 3) & (inline < 2000) & (F.length(html) <= 20 * F.greatest(text_chars, F.lit(1))), F.lit(False))


def page_type(content_type: Column, content_status: Column, quality: Column, text: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    page = kind.isin("", "text/html", "application/xhtml+xml", "text/plain")
    return F.when(~page, "document").when(content_status == "navigation_only", "list").when((quality == "failed") | (F.coalesce(text, F.lit("")) == ""), "unreadable").otherwise("article")


def fetch_relevance(score: Column, best: Column, engines: Column, url: Column) -> Column:
    """How soon a result is worth reading, by its score, engines and kind of source."""
    ratio = F.when(best > 0, score / best)
    return F.when(ratio >= 0.60, "high").when((ratio <= 0.15) & (engines < 2), "low").when((engines >= 2) | signals.source_type(url).isin("docs", "paper", "repo", "reference"), "high").otherwise("medium")


def reading_gap(quality: Column, content_status: Column, partial: Column, focus: Column) -> Column:
    return F.when(quality.isin("failed", "thin", "suspect"), quality).when(content_status.isin("navigation_only", "image_content"), content_status).when(partial, "partial_capture").when(focus == "no_term_matches", "focus_not_found").otherwise("")


LIVE = r"(?i)(?:^|[/_-])live(?:[/_-]|$)|live-?(?:updates|blog|news)"
LIFETIMES = {"live": 300, "feed": 600, "hub": 900, "stable": 21 * 86_400}


def volatility(url: Column, content_type: Column, dated: Column) -> Column:
    """How fast a page changes: live, feed, hub or stable."""
    path = F.when(urls.path(url) == "", F.lit("/")).otherwise(urls.path(url))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    front = (F.size(segments) == 0) | ((F.size(segments) == 1) & (F.length(F.try_element_at(segments, F.lit(1))) <= 24))
    page = F.coalesce(content_type, F.lit("")).isin("", "html", "text/html")
    return F.when(path.rlike(LIVE), "live").when(content_type.isin("application/rss+xml", "application/atom+xml"), "feed").when(page & ~dated & front, "hub").otherwise("stable")


def lifetime(kind: Column, limited: Column) -> Column:
    """Seconds that a read may be served again; an hour at most for a limited one."""
    seconds = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in LIFETIMES.items()])
    return F.when(limited, F.least(seconds, F.lit(3600))).otherwise(seconds)


def resolve_outcome(policy_blocked: Column, text: Column, challenged: Column, status: Column, quality: Column, partial: Column) -> Column:
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(policy_blocked, "blocked").when(empty & (challenged | F.coalesce(status.isin(401, 403), F.lit(False))), "blocked").when(empty, "failed").when((quality != "ok") | partial, "partial").otherwise("usable")


def retryable(outcome: Column, status: Column) -> Column:
    """Whether a failed read is worth another try; null where no status tells."""
    return F.when(outcome == "failed", status.isin(408, 425, 429) | (status >= 500)).otherwise(F.lit(False))


def failure_kind(tier: Column, outcome: Column, reason: Column) -> Column:
    """What a failed step says about a site; null for what says nothing about it."""
    why = F.coalesce(reason, F.lit(""))
    own = (tier == "render") & why.rlike("^render_(busy:|http_|Connection|Read|Connect|Timeout)")
    return (
        F.when(outcome.isin("extracted", "thin", "shell", "response", "skipped") | tier.isNull() | (tier == "") | own, F.lit(None).cast("string"))
        .when((tier == "headed") & why.contains("challenge_unresolved"), F.concat(F.lit("wall:"), F.regexp_extract(why, "([^:]*)$", 1)))
        .when((outcome == "challenge") | why.contains("challenge"), "challenge")
        .when(why.startswith("no_response_in_"), "silent")
        .when(why.rlike("Timeout|ConnectionError|SSLError"), "timeout")
        .when(why.rlike("_(403|429|401|451|202)$"), "blocked")
    )


def is_refusal(reason: Column) -> Column:
    """Whether a failure says to stop asking, not that a page is missing."""
    return F.when(reason.contains("http_"), reason.rlike("_(429|503|403)$")).otherwise(F.coalesce(reason.rlike("Timeout|ConnectionError|TooManyRedirects|SSLError"), F.lit(False)))


def availability(count: Column, status: Column, upstream: Column) -> Column:
    """What a provider's answer says of it."""
    down = F.coalesce(upstream.isin("cooldown", "recovery_in_progress", "unavailable"), F.lit(False))
    fine = status.isin("ok", "cached", "no_results", "no_matching_candidates")
    return (
        F.when(status.isin("not_requested", "not_configured", "capped"), status)
        .when((count > 0) & (~fine | down), "degraded")
        .when(count > 0, "available")
        .when(down, "unavailable")
        .when(fine, "empty")
        .when(status.isin("unknown", "thin_or_empty", "indeterminate"), "unknown")
        .otherwise("unavailable")
    )


def garbage_layer(text: Column) -> Column:
    """A text layer of glyph numbers: ten marks, or three that are 2 % of it."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(\(cid:\d+\))"), F.lit(1))
    size = F.aggregate(marks, F.lit(0), lambda n, m: n + F.length(m))
    return (F.size(marks) >= 10) | ((F.size(marks) >= 3) & (size >= 0.02 * F.greatest(F.length(text), F.lit(1))))


def fragment_text(fragment: Column) -> Column:
    """Markup as text: code blocks fenced, items dashed, breaks kept."""
    out = F.regexp_replace(F.coalesce(fragment, F.lit("")), r"(?is)<pre[^>]*>(.*?)</pre>", "\n```\n$1\n```\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</li>|</h\d>|</blockquote>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<li[^>]*>", "- "), r"<[^>]+>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \t\n\r\x0b\x0c "))


def table_cell(value: Column, most: int = 2000) -> Column:
    """A cell of a text table: one line, its bars and ampersands written out."""
    plain = F.substring(F.trim(F.replace(F.coalesce(value, F.lit("")), F.lit("\n"), F.lit(" "))), 1, most)
    return F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("|"), F.lit("&#124;"))


def headline_key(title: Column) -> Column:
    """Up to eight ASCII words of more than two letters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]+", " ")), " +")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, 8), " ")


def clipped(text: Column, most: int) -> Column:
    """White space folded, cut at a blank."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    head = F.substring(plain, 1, most)
    return F.when(F.length(plain) <= most, plain).otherwise(F.trim(F.regexp_replace(head, " [^ ]*$", "")))


ROUNDUP = r"(?i)\bschool assembly\b|\bnews headlines (?:today|for)\b|\bheadlines (?:today|of the day)\b|\btoday'?s (?:top )?headlines\b|\btop \d+ (?:news|headlines|stories)\b|\bnews (?:roundup|round-up|digest|wrap)\b"


def news_tier(url: Column, title: Column, published: Column, now: Column, fresh_days: float = 7.0) -> Column:
    """0 fresh, 1 undated, 2 stale, 3 a front page, social post or roundup."""
    age = (F.unix_micros(now) - F.unix_micros(published)) / 86_400e6
    return F.when(urls.landing_path(url) | signals.is_social(url) | F.coalesce(title.rlike(ROUNDUP), F.lit(False)), 3).when(published.isNull(), 1).when(age <= fresh_days, 0).otherwise(2)


SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def listed_title(html: Column) -> Column:
    """The first title of a page as a list of results has it: white space folded, and
    the four named references that end in a semicolon written out, once each."""
    out = F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    # ends are free of all Unicode space separators, as trimmed by the SQL
    return F.btrim(F.regexp_replace(out, r"[\t\n\f\r ]+", " "), F.lit(SPACES))
