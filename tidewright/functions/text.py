"""Scalar text functions as column expressions.

What needs Unicode normalisation or case folding beyond the JVM's is an Arrow
function; everything else stays in generated code.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Words that carry no topic in the short planning list.
PLANNING_STOP = ("the", "of", "and", "for", "in", "on", "a", "an", "to", "with", "de", "la", "les", "en", "du", "des")
# Title words too general to count as a topic.
GENERAL_WORDS = (
    "city", "county", "municipality", "village", "town", "province", "state", "country", "district", "region", "capital", "legislature", "government",
    "rights", "people", "language", "justice", "social", "law", "legislation", "wisdom", "reason", "violence", "university", "college",
)
# Beginnings of category titles that say nothing about a topic.
NOISE_PREFIXES = (
    "wikipedia ", "articles ", "all wikipedia", "use ", "cs1 ", "webarchive ", "pages ", "short description", "good articles", "featured articles",
    "template ", "maintenance ", "tracking ", "births ", "deaths ", "villages ", "cities ", "towns ", "populated places ",
)
# Words inside category titles that say nothing about a topic.
NOISE_WORDS = ("wikidata", "wikipedia")
LEMMA_CHARS = 300


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StructType([StructField("lemma", StringType()), StructField("key", StringType())]))
def _lemma(s: pd.Series) -> pd.DataFrame:
    clean = s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())
    return pd.DataFrame({"lemma": clean.map(lambda x: None if x is None else x[:LEMMA_CHARS]), "key": clean.map(lambda x: None if x is None else x.casefold()[:LEMMA_CHARS])})


def normalized_lemma(c: Column | str) -> Column:
    """struct(lemma, key): NFKC and stripped; the key case-folded, then cut."""
    return _lemma(_col(c))


def squeezed(c: Column | str) -> Column:
    """Underscores as spaces, lower case, single spaces, no outer ones."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_col(c), "_", " ")), r"\s+", " "))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    plain = s.fillna("").map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii").lower())
    return plain.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def ascii_folded(c: Column | str) -> Column:
    """Compatibility-decomposed, ASCII only, lower case, words of a-z and 0-9 with single spaces."""
    return _fold(_col(c))


def ascii_words_only(c: Column | str) -> Column:
    """``ascii_folded`` for text without accents, in generated code."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def stem(word: Column | str) -> Column:
    """A cautious stem: three families, -ies to -y, plural -s of longer words."""
    w = _col(word)
    long_ = F.length(w) > 5
    return (
        F.when(w.startswith("educat"), "educat")
        .when(w.startswith("universit"), "universit")
        .when(w.startswith("school"), "school")
        .when(w.endswith("ies") & long_, F.regexp_replace(w, "ies$", "y"))
        .when(w.endswith("s") & long_ & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def tokens(c: Column | str, *, pattern: str = "[a-z0-9]+", least: int = 1, stop: tuple[str, ...] = (), distinct: bool = True, stemmed: bool = False) -> Column:
    """Words of the lower-cased text; the variants differ in least length, stop words, stems and repeats."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({pattern})"), 1)
    found = F.filter(found, lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True)))
    if stemmed:
        found = F.transform(found, stem)
    return F.array_distinct(found) if distinct else found


def shared_words(a: Column, b: Column) -> Column:
    """Number of words that two word lists share."""
    return F.size(F.array_intersect(a, b))


def label_variants(c: Column | str) -> Column:
    """A label, its 'Education' form, and its plural."""
    x = _col(c)
    forms = F.array(
        x,
        F.when(x.startswith("Educational "), F.concat(F.lit("Education "), F.substring(x, 13, 1 << 20))),
        F.when(x.endswith("y"), F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies"))).when(~x.endswith("s"), F.concat(x, F.lit("s"))),
    )
    return F.array_distinct(F.array_compact(forms))


def page_title(c: Column | str) -> Column:
    """White space as single underscores."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), r"\s+", "_")


def language_code(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """A language tag in lower case with hyphens, its first part by alias; ``und`` if it is none."""
    tag = F.translate(F.lower(F.trim(_col(c))), "_", "-")
    ok = (F.length(tag) <= 40) & tag.rlike("^[a-z0-9]{2,8}(-[a-z0-9]{1,8})*$")
    if aliases:
        first = F.substring_index(tag, "-", 1)
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        tag = F.concat(F.coalesce(F.try_element_at(table, first), first), F.substring(tag, F.length(first) + 1, F.lit(64)))
    return F.when(ok, tag).otherwise("und")


def external_url(domain: Column | str, path: Column | str) -> Column:
    """The URL of an index entry whose host labels stand in reverse; empty if it is none."""
    d = _col(domain)
    scheme = F.regexp_extract(d, "^(https?://|//)", 1)
    host = F.regexp_replace(F.regexp_replace(d, "^(https?://|//)", ""), r"\.+$", "")
    labels = F.split(host, r"\.")
    url = F.concat(F.when(scheme == "//", "https://").otherwise(scheme), F.array_join(F.reverse(labels), "."), F.coalesce(F.nullif(_col(path), F.lit("")), F.lit("/")))
    return F.when((scheme != "") & ~F.array_contains(labels, ""), url).otherwise("")


def entity_id(c: Column | str) -> Column:
    """The Q-number in plain form or at the end of a URL; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?:^|/)(Q[1-9][0-9]*)$", 1), F.lit(""))


def concept_id(c: Column | str) -> Column:
    """The concept number in plain form or at the end of a URL; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?:^|/)(concept[1-9][0-9]*)$", 1), F.lit(""))


def candidate_key(*parts: Column | str, prefix: str = "V32_C_", joint: str = "|", length: int = 26) -> Column:
    """A deterministic id: prefix and the first hex digits of the SHA-256 of the joined parts."""
    text = F.concat_ws(joint, *[_col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def word_count(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(r"(\S+)"), 1))


def ascii_host(host: str | None) -> str | None:
    """A host (with or without port) as IDNA writes it; one that IDNA refuses stays as it is."""
    try:
        return host and host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


@F.pandas_udf(StringType())
def _idna(s: pd.Series) -> pd.Series:
    return s.map(ascii_host)


def url_parts(c: Column | str) -> Column:
    """A URL with scheme and host in lower case, without default port and fragment; hosts in ASCII (IDNA).

    Only hosts with other characters go to Python.
    """
    x = F.trim(_col(c))
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(host.rlike(r"[^\x00-\x7f]"), _idna(host)).otherwise(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(scheme == "", None).otherwise(F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def search_words(c: Column | str, least: int = 1) -> Column:
    """Distinct words of letters, digits, _ and - in lower case."""
    clean = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_-]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(clean), " +"), lambda w: F.length(w) >= least))


def plain_markdown(c: Column | str) -> Column:
    """Markdown without links, emphasis and code marks."""
    x = F.regexp_replace(_col(c), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(x, r"[*_`]+", ""))


def guarded_cell(c: Column | str) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    x = _col(c).cast("string")
    return F.when(x.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), x)).otherwise(x)


def typed_brief(value: Column) -> Column:
    """The text of a typed value struct(id, text, time, amount, latitude, longitude), first that is there."""
    place = F.when(value["latitude"].isNotNull() & value["longitude"].isNotNull(), F.concat_ws(",", value["latitude"].cast("string"), value["longitude"].cast("string")))
    return F.coalesce(value["id"], value["text"], value["time"], value["amount"], place)


def clipped(c: Column | str, chars: int) -> Column:
    """struct(value, cut): a text's first characters, and whether there were more."""
    x = _col(c)
    return F.struct(F.substring(x, 1, chars).alias("value"), (F.length(x) > chars).alias("cut"))


def listed(c: Column | str) -> Column:
    """A JSON array of strings as text with semicolons."""
    return F.array_join(F.from_json(_col(c), "array<string>"), ";")


def unlisted(c: Column | str) -> Column:
    """Text with semicolons as an array, empty items dropped."""
    return F.filter(F.transform(F.split(_col(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def iso_utc(ts: Column | str) -> Column:
    """A timestamp as ISO text in UTC to the second."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def contains_plain(text: Column | str, query: str) -> Column:
    """Whether a text contains a query, accents and case aside."""
    return F.contains(F.collate(_col(text), "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI"))


def in_locale(values: Column, locale: str, fallback: str = "en") -> Column:
    """struct(text, status) from a map by locale: exact, base language, fallback."""
    base = locale.split("-")[0]
    get = lambda key: F.try_element_at(values, F.lit(key))
    text = F.coalesce(get(locale), get(base), get(fallback))
    status = F.when(get(locale).isNotNull(), "exact").when(get(base).isNotNull(), "base").when(get(fallback).isNotNull(), "fallback").otherwise("missing")
    return F.struct(text.alias("text"), status.alias("status"))
