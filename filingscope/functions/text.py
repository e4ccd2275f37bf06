"""Text functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and case patterns.
TOKEN = r"[a-z0-9][a-z0-9'-]{1,39}"
CASE_NUMBER = r"^[A-Z][A-Z0-9-]{2,30}$"
FORMAL_CASE = r"(?i)\b(?:FC|formal\s+case|case|docket)\s*(?:no\.?|number)?\s*[-#:]?\s*(\d{3,5})\b"
GENERIC_CASE = r"(?i)\b([a-z]{1,12}-?\d{3,5}(?:-[a-z0-9]{1,8}){0,3})\b"
BARE_FORMAL_CASE = r"(?i)^(?:(?:fc|formal\s+case|case|docket)\s*(?:no\.?|number)?\s*[-#:]*\s*)?\d{3,5}$"
BARE_GENERIC_CASE = r"(?i)^[a-z]{1,12}-?\d{3,5}(?:-[a-z0-9]{1,8}){0,3}$"
ALL_CASES = (
    r"(?i)\bFC\s*[-#:]?\s*(\d{3,5})\b",
    r"(?i)\bFormal\s+Case\s+(?:No\.?|Number)?\s*[-#:]?\s*(\d{3,5})\b",
    r"(?i)\bcaseNumber=(\d{3,5})\b",
    r"(?i)\bcase\s+(?:no\.?|number)?\s*[-#:]?\s*(\d{3,5})\b",
    r"(?i)\bdocket\s+(?:no\.?|number)?\s*[-#:]?\s*(\d{3,5})\b",
)
PROBES = (
    r"(system|developer)\s+(prompt|instructions?)",
    r"(api|secret|access)\s*keys?",
    r"reveal.{0,40}(prompt|instructions?|keys?|secrets?)",
    r"ignore.{0,40}(previous|prior|system|developer).{0,40}(instructions?|prompt)",
)
FOLLOW_UP = r"(?i)\b(?:what about|how about|and (?:in|for)|same for|those|these|that case|it|they)\b"
# Words that a search leaves out.
STOP_WORDS = (
    "about after also an and are can could document documents case cases commission dc discuss discussed discusses discussion "
    "across docket dockets filing filings find for from give have into link links mention mentions please psc that the "
    "number numbers official recent their this was were what when where which with would in is it of or to"
).split()
LOCAL_STOP_WORDS = (
    "a about all an and are can case could document documents find for formal from in inside is it mention mentions of on "
    "or please search show specific that the this to what which with within would you"
).split()
TOPIC_WORDS = "psc,public service commission,docket,formal case,rate case,pepco,washington gas,dc water,utility,utilities,energy,renewable,solar,electric,electricity,gas,telecom,water,complaint,consumer,hearing,grid".split(",")
# Endings that a stem loses, and the least length of what is left.
DERIVED_ENDINGS, DERIVED_LEAST = ("ations", "ation", "ions", "ion"), 7
INFLECTED_ENDINGS, STEM_LEAST = ("ing", "ed", "es", "s"), 5
MOST_TERMS = 12


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match or with an empty one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case words of 2 to 40 characters; null counts as empty. Letters beyond a-z split words."""
    return matches(F.lower(F.coalesce(text, F.lit(""))), TOKEN)


def stem(word: Column) -> Column:
    """The stem of a word in any case of letters."""
    return lower_stem(F.lower(word))


def lower_stem(word: Column) -> Column:
    """A prefix of a lower-case word: derivational endings go first, then inflectional ones; possessives and short words stay."""
    out = F.when((F.length(word) <= STEM_LEAST) | F.endswith(word, F.lit("'s")), word)
    for endings, least in ((DERIVED_ENDINGS, DERIVED_LEAST), (INFLECTED_ENDINGS, STEM_LEAST)):
        for ending in endings:
            out = out.when(F.endswith(word, F.lit(ending)) & (F.length(word) - len(ending) >= least), F.substring(word, F.lit(1), F.length(word) - len(ending)))
    return out.otherwise(word)


def stems(text: Column) -> Column:
    """Distinct stems of a text in order of first use."""
    return F.array_distinct(F.transform(F.array_distinct(tokens(text)), lower_stem))  # tokens are in lower case; each ending would ask for it again


def query_terms(message: Column) -> Column:
    """Search terms of a question: words of quoted phrases first, then the others; at most twelve."""
    message = F.coalesce(message, F.lit(""))
    quoted = F.array_join(matches(message, "[“\"]([^”\"]{2,80})[”\"]", 1), " ")
    words = F.array_distinct(tokens(F.concat(quoted, F.lit(" "), message)))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.filter(words, lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^fc?\d+$")), 1, MOST_TERMS)


def decode_entities(text: Column) -> Column:
    """Six entities in a fixed order, so a doubly escaped one is decoded twice; then white space collapses."""
    out = F.regexp_replace(text, "(?i)&nbsp;", " ")
    for name, sign in (("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_html(html: Column) -> Column:
    return decode_entities(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))


def document_stems(html: Column) -> Column:
    """Distinct stems of stored page markup."""
    return stems(strip_html(html))


def case_identifier(text: Column) -> Column:
    """The case that a text names: a formal number, else a generic identifier; null without either."""
    return F.coalesce(F.concat(F.lit("FC"), found(text, FORMAL_CASE)), F.upper(found(text, GENERIC_CASE)))


def all_case_numbers(text: Column) -> Column:
    """Distinct numbers of five patterns, pattern by pattern."""
    return F.array_distinct(F.concat(*(matches(text, p, 1) for p in ALL_CASES)))


def is_bare_case_number(text: Column) -> Column:
    text = F.trim(text)
    return text.rlike(BARE_FORMAL_CASE) | text.rlike(BARE_GENERIC_CASE)


def is_probe(text: Column) -> Column:
    """Whether a message asks for instructions or credentials."""
    text, out = F.lower(text), F.lit(False)
    for p in PROBES:
        out = out | text.rlike(p)
    return out


def word_count(text: Column) -> Column:
    return F.size(matches(text, r"\S+"))


def is_follow_up(message: Column, terms: Column) -> Column:
    """Whether a question leans on the one before: no case of its own, and a phrase that refers back or hardly any words."""
    few = (F.size(terms) > 0) & (F.size(terms) <= 2) & (F.size(F.split(F.trim(message), r"\s+")) <= 8)
    return case_identifier(message).isNull() & (message.rlike(FOLLOW_UP) | few)


def is_short_query(text: Column) -> Column:
    text = F.trim(text)
    return (F.length(text) > 0) & ((word_count(text) <= 4) | (F.length(text) <= 32))


def is_on_topic(text: Column, words: list[str] = TOPIC_WORDS) -> Column:
    low, out = F.lower(F.trim(text)), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return (F.length(low) > 0) & (is_bare_case_number(text) | (F.size(all_case_numbers(text)) > 0) | out)


def short_query_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def query_years(text: Column, as_of: str) -> Column:
    """Distinct years from 1990 to the one after ``as_of`` that a text names."""
    years = F.transform(matches(text, r"\b(?:19|20)\d{2}\b"), lambda y: y.cast("int"))
    return F.array_distinct(F.filter(years, lambda y: (y >= 1990) & (y <= F.year(F.to_date(F.lit(as_of))) + 1)))


def phrase_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def local_query(text: Column) -> Column:
    """The query of the fielded search: without case references and its own stop words; the text itself if nothing is left."""
    bare = F.regexp_replace(text, r"(?i)\b(?:FC\s*|formal\s+case\s*)\d{3,5}\b", " ")
    stop = F.array(*map(F.lit, LOCAL_STOP_WORDS))
    words = F.filter(F.split(phrase_form(bare), " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), text)


def normal_case_number(value: Column) -> Column:
    value = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    return F.when(F.length(value) == 0, "UNKNOWN").when(value.rlike("^[A-Z]"), value).otherwise(F.concat(F.lit("FC"), value))


def docket_cases(docket: Column) -> Column:
    """Distinct case numbers of a comma-separated docket list; what follows the last ' - ' of each isn't part of it."""
    labels = F.transform(F.split(F.coalesce(docket, F.lit("")), ","), lambda d: F.replace(F.upper(F.trim(F.regexp_replace(F.trim(d), "^(.*) - .*$", "$1"))), F.lit(" "), F.lit("")))
    return F.array_distinct(F.filter(labels, lambda x: x.rlike(CASE_NUMBER)))


def is_related_docket(docket: Column, case_number: Column) -> Column:
    """Whether a docket list has an entry of the case as a formal one or a related docket, by its bare number."""
    return F.coalesce(F.regexp_like(docket, F.concat(F.lit(r"(?i)(?:^|,\s*)(?:FC|DR)"), case_number, F.lit(r"\s*-"))), F.lit(False))


def related_cases(case_number: Column, docket: Column, most: int | None = 12) -> Column:
    """The case and those of its docket list, distinct in order; ``most`` None for all."""
    every = F.array_distinct(F.concat(F.array(F.upper(case_number)), docket_cases(docket)))
    return F.slice(every, 1, most) if most else every


def citation_title(title: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r"[\[\]\r\n]+", " "), r"\s+", " "))
    return F.when(F.length(clean) > 120, F.concat(F.rtrim(F.substring(clean, 1, 117)), F.lit("..."))).otherwise(clean)


def pdf_page_url(url: Column, page: Column) -> Column:
    return F.concat(F.regexp_replace(url, "#.*", ""), F.lit("#page="), F.greatest(F.lit(1), page.cast("long")).cast("string"))


def citation(title: Column, url: Column, page: Column, kind: Column) -> Column:
    """Markdown link to a page, or to the record if only metadata is known."""
    record = F.concat(F.lit("["), citation_title(title), F.lit(" — filing record]("), url, F.lit(")"))
    content = F.concat(F.lit("["), citation_title(title), F.lit(" — p. "), page.cast("string"), F.lit("]("), pdf_page_url(url, page), F.lit(")"))
    return F.when(kind.eqNullSafe("metadata"), record).otherwise(content)


def host(url: Column) -> Column:
    """Lower-case host, null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_official_url(url: Column, domain: str) -> Column:
    return F.coalesce((host(url) == domain) | F.endswith(host(url), F.lit("." + domain)), F.lit(False))


def is_attachment_url(url: Column, attachment_host: str, path: str) -> Column:
    """Whether a URL has the form of an official attachment: https, host, path, a numeric id and a PDF's name."""
    query = lambda k: F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit(""))
    name = F.regexp_replace(query("guidFileName"), "(?i)(?:#|%23).*$", "")
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (host(url) == attachment_host) & (F.lower(F.try_parse_url(url, F.lit("PATH"))) == path.lower()) & query("attachId").rlike(r"^\d+$") & name.rlike(r"(?i)^[\w.-]+\.pdf$")
    return F.coalesce(ok, F.lit(False))


def normal_url(url: Column, domain: str) -> Column:
    """https for the official domain, and the spelling that its case-sensitive paths need."""
    out = F.trim(F.coalesce(url, F.lit("")))
    out = F.when(F.contains(out, F.lit(domain)) & out.startswith("http:"), F.regexp_replace(out, "^http:", "https:")).otherwise(out)
    fixed = out
    for pattern, right in (("(?i)/search/", "/Search/"), ("(?i)casedetail", "CaseDetail"), ("(?i)casesearch", "CaseSearch"), ("(?i)casenumber=", "caseNumber=")):
        fixed = F.regexp_replace(fixed, f"^((?s:.*?)){pattern}", "$1" + right)
    return F.when(F.contains(out, F.lit("edocket." + domain)), fixed).otherwise(out)


def is_stable_url(url: Column, domain: str, stable: list[str]) -> Column:
    """Whether a URL is one of the pages that always exist."""
    return normal_url(url, domain).isin(*stable)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def safe_text(value: Column, limit: int) -> Column:
    """Without control characters, trimmed and cut to ``limit`` with an ellipsis; 'Not provided' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0B-\x1F]", ""), r"^\s+|\s+$", "")
    return F.when(F.length(clean) == 0, "Not provided").when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean)


def indented(value: Column, limit: int) -> Column:
    return F.regexp_replace(safe_text(value, limit), "(?m)^", "    ")


def page_html(page: Column, text: Column) -> Column:
    """A stored page: its number and escaped text."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<section data-page="'), page.cast("string"), F.lit('"><pre>'), safe, F.lit("</pre></section>"))


def long_date(value: Column) -> Column:
    """'January 5, 2024'; 'Unknown' for null or empty, the value itself if it is no date."""
    day = F.try_to_timestamp(value)
    return F.when(value.isNull() | (value == ""), "Unknown").otherwise(F.coalesce(F.date_format(day, "MMMM d, yyyy"), value))


def document_year(received: Column) -> Column:
    year = F.try_to_number(F.substring(received, 1, 4), F.lit("9999")).cast("int")
    return F.when(year >= 1900, year)
