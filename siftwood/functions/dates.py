"""Date parsing and provenance as column expressions; ``now`` is a column or literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How dates are written in results.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
FORMS = (r"\b(20\d{2}-\d{2}-\d{2})\b", rf"(?i)\b(\d{{1,2}}\s+{MONTH}\s+20\d{{2}})\b", rf"(?i)\b({MONTH}\s+\d{{1,2}},?\s+20\d{{2}})\b")
RELATIVE = r"(?i)^\s*(\d+|an?|one)\s+(minute|hour|day|week|month|year)s?\s+ago\b"

ZONES = "(?:Z|[+-][0-9]{2}:?[0-9]{2}|GMT|UTC|UT|EST|EDT|CST|CDT|MST|MDT|PST|PDT)"


def _offset(zone: Column) -> Column:
    """A zone's distance from UTC in seconds."""
    named = F.element_at(F.create_map(*[F.lit(x) for pair in {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}.items() for x in pair]), zone)
    hours, minutes = F.regexp_extract(zone, "^[+-]([0-9]{2})", 1).try_cast("int"), F.regexp_extract(zone, "([0-9]{2})$", 1).try_cast("int")
    signed = F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60)
    return F.when(zone.rlike("^[+-]"), signed).otherwise(F.coalesce(named * 3600, F.lit(0)))


def parse_date(text: Column) -> Column:
    """A moment (UTC) from an RFC 2822 or ISO date or time, or from the first written
    date in a text; without a zone it is UTC, without a time midnight; null if there's none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    clock = "([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"
    iso = f"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[T ]{clock}(?:\\.[0-9]+)?\\s*({ZONES})?)?$"
    mail = f"^(?:[A-Za-z]{{3}},\\s*)?([0-9]{{1,2}}\\s+[A-Za-z]{{3}}\\s+[0-9]{{4}})\\s+{clock}\\s*({ZONES})?$"

    def moment(day: Column, time: Column, zone: Column) -> Column:
        whole = F.concat(day.cast("string"), F.lit(" "), F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time))
        return F.timestamp_seconds(F.unix_timestamp(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss"))) - _offset(zone))

    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    return F.coalesce(
        F.when(t.rlike(mail), moment(_dated(part(mail, 1)), part(mail, 2), part(mail, 3))),
        F.when(t.rlike(iso), moment(F.try_to_date(part(iso, 1), "yyyy-MM-dd"), part(iso, 2), part(iso, 3))),
        first_date(t).cast("timestamp"),
    )


def _dated(found: Column) -> Column:
    """A written date as DATE, by its month's first three letters."""
    day = F.regexp_extract(found, r"(?:^|\D)(\d{1,2})(?:\D|$)", 1)
    month = F.initcap(F.substring(F.regexp_extract(found, r"([A-Za-z]{3,})", 1), 1, 3))
    year = F.regexp_extract(found, r"(20\d{2})", 1)
    number = F.floor((F.position(month, F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) + 2) / 3)
    return F.try_to_date(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def first_date(text: Column) -> Column:
    """The first date in a text by the forms in order; null if there's none."""
    out = F.try_to_date(F.regexp_extract(text, FORMS[0], 1), "yyyy-MM-dd")
    for form in FORMS[1:]:
        found = F.regexp_extract(text, form, 1)
        out = F.coalesce(out, F.when(found != "", _dated(found)))
    return out


def relative_date(text: Column, now: Column) -> Column:
    """The date that a leading "3 days ago" stands for at ``now``."""
    number, unit = F.lower(F.regexp_extract(text, RELATIVE, 1)), F.lower(F.regexp_extract(text, RELATIVE, 2))
    n = F.when(number.isin("a", "an", "one"), 1).otherwise(F.expr("null").cast("int"))
    n = F.coalesce(n, F.when(number.rlike(r"^\d+$"), number.cast("int")))
    seconds = F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86_400).when(unit == "week", 7 * 86_400).when(unit == "month", 30 * 86_400).when(unit == "year", 365 * 86_400)
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(now) - n * seconds))


def age_days(day: Column, now: Column) -> Column:
    """Whole days since, 0 for the future, null for undated."""
    return F.greatest(F.datediff(F.to_date(now), day), F.lit(0))


def recency(score: Column, age: Column, weight: float, half_life: float = 21.0) -> Column:
    """A score lowered with age; undated rows aren't."""
    return score * ((1 - weight) + weight * F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0)))


def provenance(published: Column, declared: Column, snippet: Column) -> Column:
    """(value, source) of a row's date: the provider's (structured, or as declared:
    snippet or page), else the first written one of its snippet, else none."""
    given = F.trim(F.coalesce(published, F.lit("")))
    said = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(snippet, F.lit("")), form, 1), F.lit("")) for form in FORMS])
    source = F.when(given != "", F.when(declared.isin("snippet", "page"), declared).otherwise("structured")).when(said.isNotNull(), "snippet").otherwise("none")
    return F.struct(F.when(given != "", given).otherwise(F.coalesce(said, F.lit(""))).alias("value"), source.alias("source"))


def rejection(when: Column, now: Column) -> Column:
    """Why a moment can't be a publication date: it is more than a day ahead."""
    return F.when(F.unix_micros(when) > F.unix_micros(now) + 86_400_000_000, "future")


def public_fields(found: Column, now: Column) -> Column:
    """(published_at, hint, rejected): a provider's or page's date is the publication
    date; a snippet's is a hint; one that can't be is named with the reason."""
    when = parse_date(found["value"])
    bad = rejection(when, now)
    firm = found["source"].isin("structured", "page") & bad.isNull() & when.isNotNull()
    return F.struct(F.when(firm, F.to_date(when)).alias("published_at"), F.when(bad.isNull() & (found["source"] == "snippet"), found["value"]).alias("hint"), bad.alias("rejected"))


def page_date(declared: Column, guessed: Column, html: Column) -> Column:
    """A page's date: the declared one, else a guess whose year stands in the page."""
    year = F.regexp_extract(F.coalesce(guessed, F.lit("")), r"^\s*([0-9]{4})-[0-9]{2}-[0-9]{2}", 1)
    return F.when(F.coalesce(declared, F.lit("")) != "", declared).when((year != "") & ~F.contains(F.coalesce(html, F.lit("")), year), "").otherwise(F.coalesce(guessed, F.lit("")))
