"""Values as reports give them: nulls in disguise, numbers in text, countries, sectors, quarters, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country codes and aliases.
COUNTRIES = {
    "US": "United States", "USA": "United States", "GB": "United Kingdom", "UK": "United Kingdom", "DE": "Germany",
    "JP": "Japan", "CN": "China", "CA": "Canada", "FR": "France", "AU": "Australia", "CH": "Switzerland",
    "NL": "Netherlands", "SE": "Sweden", "IE": "Ireland", "IT": "Italy", "ES": "Spain", "KR": "South Korea",
    "IN": "India", "BR": "Brazil", "SG": "Singapore", "HK": "Hong Kong", "IL": "Israel", "MX": "Mexico",
}
# Sector synonyms.
SECTORS = {
    "Technology": "Information Technology",
    "Info. Tech.": "Information Technology",
    "Healthcare": "Health Care",
    "Cons. Discr.": "Consumer Discretionary",
}
# Words that show an instrument rather than a company; all are Financials / Capital Markets.
INSTRUMENT_WORDS = [
    "bitcoin", "ethereum", "ether", "crypto", "blockchain", "btc", "eth", "digital asset", "defi", "web3",
    "etf", "ishares", "vanguard etf", "spdr", "invesco", "proshares", "direxion", "wisdom tree",
    "spac", "acquisition corp", "blank check",
    "warrant", "rights", "call option",
    "treasury", "t-bill", "t-bond", "tbill", "us government",
]


def clean_text(value: Column) -> Column:
    """Null for NaN, None and blank, in any case."""
    return F.when(F.lower(F.trim(value)).isin("nan", "none", ""), None).otherwise(value)


def clean_number(value: Column) -> Column:
    """A number out of a table cell: dashes and lone signs are null; a cell with both brackets anywhere is negative."""
    text = F.trim(value)
    digits = F.regexp_replace(text, r"[^0-9.\-]", "")
    number = digits.try_cast("double")
    number = F.when(F.length(digits) > 0, number)
    signed = F.when(text.contains("(") & text.contains(")"), -F.abs(number)).otherwise(number)
    return F.when(text.isin("", "-", "—", "–"), None).otherwise(signed)


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def country_name(value: Column) -> Column:
    """A full country name for a known code; anything else stays."""
    return _mapped(value, COUNTRIES)


def sector_name(value: Column) -> Column:
    return _mapped(value, SECTORS)


def is_instrument(name: Column) -> Column:
    """Whether a name holds one of the instrument words, anywhere."""
    return F.lower(name).rlike("|".join(w.replace(".", r"\.") for w in INSTRUMENT_WORDS))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def money(value: Column) -> Column:
    """An amount as a decimal, so that sums do not depend on their order."""
    return value.cast("decimal(18,2)")


def share(part: Column, total: Column, digits: int = 4) -> Column:
    """part / total as a percentage; a total of 0 or null counts as 1."""
    return F.round(part.cast("double") * 100 / F.coalesce(F.nullif(total.cast("double"), F.lit(0.0)), F.lit(1.0)), digits)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
