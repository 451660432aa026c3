"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that don't corroborate a passage.
STOP_WORDS = (
    "a an and are as at be been before by can could did do does for from had has have "
    "how i in is it its me must of on or should that the their them there these they "
    "this to was were what when where which who why will with would you your"
).split()


def folded(text: Column) -> Column:
    """Case folded: lower case, with the sharp s written out."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def terms(text: Column) -> Column:
    """Distinct folded words that aren't question words, in order."""
    words = F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the text without case and punctuation; of nothing, an empty string."""
    plain = normalized(text)
    return F.when(plain == "", "").otherwise(F.sha2(plain, 256))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))


MOST_WORDS, LEAST_WORDS = 700, 80


def shingles(words_col: Column, width: int = 5) -> Column:
    """Distinct hashes of word runs. ``words_col`` must be a column of the frame:
    it is used for each run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words_col) - width + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words_col, i, width))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def token_estimate(text: Column) -> Column:
    """A token for each CJK character, and one for four others (one at least, if any)."""
    t = F.coalesce(text, F.lit(""))
    rest = F.length(F.regexp_replace(t, r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]", ""))
    return (F.length(t) - rest + F.when(rest > 0, F.greatest(F.floor(rest / 4), F.lit(1))).otherwise(0)).cast("long")


def smart_truncate(text: Column, most: int) -> Column:
    """Cut at the last paragraph, sentence or word end past 70 % of the budget, with a mark."""
    budget = most - 2
    head = F.substring(text, 1, budget)
    ends = []
    for sign in ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "):
        # the last place of a sign is found from the end of the reversed text
        back = F.locate(sign[::-1], F.reverse(head))
        end = F.length(head) - back + 1
        ends.append(F.when((back > 0) & (end - len(sign) >= int(budget * 0.7)), end).otherwise(F.lit(0)))
    best = F.greatest(*ends)
    cut = F.when(best > 0, F.substring(head, F.lit(1), best)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, r"\s+$", "")), F.lit(" …")))


def tidy(text: Column) -> Column:
    """White space folded line by line, empty lines dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def windows(text: Column, width: int, step: int) -> Column:
    """Runs (start, text) of ``width`` characters every ``step``, which is at least half
    of that. The text is cut into steps once and a run is a step and the start of the
    next, so the work grows with the text's length, not its square."""
    steps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    ahead = F.concat(F.slice(steps, F.lit(2), F.greatest(F.size(steps), F.lit(1))), F.array(F.lit("")))
    return F.transform(F.arrays_zip(steps.alias("a"), ahead.alias("b")), lambda p, i: F.struct((i * step).alias("start"), F.concat(p["a"], F.substring(p["b"], 1, width - step)).alias("text")))


def passages(text: Column, width: int = 1200, overlap: int = 200, least: int = 120) -> Column:
    """Overlapping runs (start, text) of more than ``least`` characters."""
    return F.filter(windows(text, width, width - overlap), lambda r: F.length(r["text"]) > least)


# Words that don't narrow a question, and what is added to one of a kind.
FILLERS = ("the", "a", "an", "of", "to", "in", "for", "on", "and", "or", "is", "are", "what", "how", "why", "when", "where", "who", "with", "from", "vs", "versus")
EXPANSIONS = {
    "comparison": "comparison benchmark",
    "howto": "step by step guide",
    "research": "paper benchmark results",
    "code": "code example implementation",
    "reference": "official documentation reference",
    "news": "latest news release",
    "factual": "technical details numbers",
}


def expanded(query: Column) -> Column:
    """A question and, for one of 2 to 14 telling words and a known kind, its expansion."""
    plain = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    telling = F.size(F.filter(tokens(plain), lambda w: ~w.isin(*FILLERS)))
    kind = intent(plain)
    more = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in EXPANSIONS.items()])
    return F.when(plain == "", F.array().cast("array<string>")).when(telling.between(2, 14) & more.isNotNull(), F.array(plain, F.concat_ws(" ", plain, more))).otherwise(F.array(plain))


def coherence_terms(query: Column) -> Column:
    """A question's distinct words of more than three letters, in order."""
    return F.filter(F.array_distinct(tokens(query)), lambda w: F.length(w) > 3)


def opaque_identifiers(query: Column) -> Column:
    """Words of twelve characters or more that hold a digit and a dash, underscore or dot."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([\w.-]{12,})"), F.lit(1))
    return F.filter(found, lambda w: w.rlike("[0-9]") & w.rlike("[-_.]"))


def anchors(query: Column, said: Column, most: int = 12, clip: int = 64) -> Column:
    """(matched, unmatched) terms of a question in a passage, in order, and their counts."""
    asked, held = terms(query), terms(said)
    short = lambda x: F.transform(F.slice(F.array_sort(x), 1, most), lambda w: F.substring(w, 1, clip))
    both, left = F.array_intersect(asked, held), F.array_except(asked, held)
    return F.struct(F.size(both).alias("matched_count"), F.size(left).alias("unmatched_count"), short(both).alias("matched"), short(left).alias("unmatched"))


def intent(query: Column) -> Column:
    """The kind of a question, the first rule that matches."""
    q = F.lower(F.coalesce(query, F.lit("")))
    # Rules in order.
    rules = (
        ("comparison", r"\b(vs\.?|versus|compare|difference between|better than)\b"),
        ("howto", r"\b(how to|tutorial|guide|install|configure|setup|set up)\b"),
        ("research", r"\b(paper|research|study|benchmark|evaluation|arxiv)\b"),
        ("code", r"\b(code|api|sdk|library|function|implementation|example)\b"),
        ("reference", r"\b(docs?|documentation|reference|manual|specification)\b"),
        ("news", r"\b(news|latest|today|release|announcement)\b"),
        ("factual", r"\b(architecture|parameter|dimension|throughput|latency|memory|version|config|specification)\b"),
    )
    out = F.lit("general")
    for name, pattern in reversed(rules):
        out = F.when(q.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def csv_cell(value: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(F.ltrim(value).rlike("^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)
