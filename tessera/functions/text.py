"""Text kernel: Column builders for normalising, tokenising, comparing and cutting text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii()}
_FROM, _TO = "".join(_BARE), "".join(_BARE.values())


def normalize(text: Column) -> Column:
    """Lower case without accents, trimmed; null is empty."""
    return F.trim(F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), r"\p{Mn}", "")))


def tokenize(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Runs of letters and digits of over two characters, repeats kept, stopwords dropped."""
    found = F.regexp_extract_all(normalize(text), F.lit("([0-9a-z]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords) if stopwords else F.length(t) > 2)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space, formed after stopwords are gone."""
    n = F.greatest(F.lit(0), F.size(tokens) - 1)  # zipped, for a lambda that indexed the tokens could compute them anew for each
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set, 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def rescale(x: Column, floor: float, ceiling: float) -> Column:
    return clamp01((x - floor) / (ceiling - floor)) if ceiling > floor else clamp01(x)


def excerpt(text: Column, limit: int = 320) -> Column:
    """White space collapsed; longer texts are cut and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def canonical_ids(text: Column) -> Column:
    """Identifiers such as AB-123, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\b[A-Z]{2,6}-\d{2,5}\b)"), F.lit(1)))


def labelled(*fields: tuple[str, Column]) -> Column:
    """'Label: value' lines of the fields that are not empty."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.trim(c))) for label, c in fields])


_LABEL = r"[A-Z][A-Za-z ]{0,40}: "


def sections(labelled_text: Column) -> Column:
    """The inverse of ``labelled``: an array of (label, value); lines without a label continue the one before, or are dropped."""
    folded = F.regexp_replace(labelled_text, rf"\n(?!{_LABEL})", " ")
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(f"^{_LABEL}"))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("label"), F.trim(F.regexp_replace(x, f"^{_LABEL}", "")).alias("value")))


def lexicon_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The lexicon's terms that occur in the normalised text, as substrings."""
    flat = normalize(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: flat.contains(t))


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
