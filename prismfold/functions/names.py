"""Company names: normal form, tokens, similarity, first entity, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a company name.
SUFFIXES = [
    "inc", "llc", "lp", "l.p.", "corp", "corporation", "ltd", "limited", "co", "holdings", "group", "holdco",
    "parent", "topco", "bidco", "buyer", "acquiror", "investor", "acquisition", "purchaser",
]
CONNECTORS = ["and", "the", "of", "dba", "fka", "aka"]


def normalize_name(name: Column) -> Column:
    """Lower case, without what is in brackets, punctuation, suffixes and connectors."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\([^)]*\)", ""), r"[,.()]", " ")
    drop = F.array(*[F.lit(w) for w in SUFFIXES + CONNECTORS])
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~F.array_contains(drop, w)), " ")


def tokens(name: Column) -> Column:
    """The distinct words of a normal form; an empty one has none."""
    return F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def first_entity(name: Column) -> Column:
    """Of several entities in one name, the first: up to a suffix that a comma follows, else up to " and "."""
    by_suffix = F.regexp_extract(name, r"(?is)^(.*?(?:inc|llc|lp|l\.p\.|corp|corporation|ltd|limited))\s*,", 1)
    cut = F.trim(F.substring_index(F.regexp_replace(name, "(?i) and ", "\x01"), "\x01", 1))
    joined = F.lower(name).contains(" and ") & (F.length(cut) >= 3)
    return F.when(by_suffix != "", F.trim(by_suffix)).when(joined, cut).otherwise(name)


def md5_uuid(text: Column) -> Column:
    """The md5 of a text, written as a UUID."""
    return F.regexp_replace(F.md5(text.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid5(namespace: str, text: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace, which is a UUID itself."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), text.cast("string").cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)
