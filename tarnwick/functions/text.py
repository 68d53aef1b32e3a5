"""Column functions over text: normalisers, tokenisers, id parsing, tolerant JSON, label maps.

White space is ``\\s`` of the default (ASCII) regular expressions, letters and digits are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.vocabulary import CLASSIFIER_INTENTS, GENERIC_TITLE_WORDS, SERVICE_INTENTS, SURVEY_MARKERS  # noqa: F401


def title_key(title: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def marked_up_title_key(title: Column) -> Column:
    """title_key without tags, and with plus signs as words."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]*>", " ")
    return title_key(F.replace(F.replace(bare, F.lit("++"), F.lit(" plusplus ")), F.lit("+"), F.lit(" plus ")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of non-space characters, punctuation included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def significant_tokens(key: Column) -> Column:
    """Distinct words of a title key that are not generic."""
    return F.array_except(F.filter(F.split(key, " "), lambda x: x != ""), F.array(*map(F.lit, GENERIC_TITLE_WORDS)))


def short_id(x: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(x, "/", -1)


def doi(x: Column) -> Column:
    """A DOI without its resolver's address, trimmed and lower-cased; null if nothing is left."""
    bare = F.replace(F.replace(x, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def lookup_id(doi_column: Column, mag: Column) -> Column:
    """``DOI:...`` if there is a DOI, else ``MAG:...``, else null."""
    return F.coalesce(F.concat(F.lit("DOI:"), doi(doi_column)), F.concat(F.lit("MAG:"), F.nullif(F.trim(mag), F.lit(""))))


def from_inverted_index(index: Column) -> Column:
    """The text of a map from words to their positions; ties of position by word; null if empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def unfenced(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def json_object(reply: Column) -> Column:
    """The JSON object that a reply is, or holds from its first to its last brace; null if neither parses."""
    whole = unfenced(reply)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(whole).isNotNull() & whole.startswith("{"), whole), F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner))


def label_map(label: Column, names: dict[str, str], default: str = "background") -> Column:
    """The label's entry; case, outer spaces and dashes for underscores do not count; the default if there is none."""
    key = F.replace(F.lower(F.trim(label)), F.lit("-"), F.lit("_"))
    entries = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def chief_intent(intents: Column) -> Column:
    """Of several intents method goes before comparison before the first; null if there is none."""
    mapped = F.transform(intents, lambda x: label_map(x, SERVICE_INTENTS))
    return F.when(F.array_contains(mapped, "method"), "method").when(F.array_contains(mapped, "comparison"), "comparison").otherwise(F.get(mapped, F.lit(0)))


def reply_intent(reply: Column) -> Column:
    """The first of comparison, method, background that a reply names; else background."""
    low = F.lower(reply)
    found = F.when(low.contains("comparison"), "comparison").when(low.contains("method"), "method")
    return found.otherwise("background")


def markers(text: Column) -> Column:
    """Distinct numbers of ``[n]`` markers, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int")))


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if some are left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def is_survey(title: Column) -> Column:
    """Whether a title is that of a survey; a missing one is not."""
    return F.coalesce(contains_any(F.lower(title), SURVEY_MARKERS), F.lit(False))
