"""What the text of filings and provider answers says: dates, names, net assets, answers in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quarter ends as schedules write them, in order of precedence.
QUARTER_ENDS = {
    r"december\s*31,?\s*(202\d)": "12-31",
    r"september\s*30,?\s*(202\d)": "09-30",
    r"june\s*30,?\s*(202\d)": "06-30",
    r"march\s*31,?\s*(202\d)": "03-31",
}
# The rows of a balance sheet that state net assets.
NET_ASSETS = r"total net assets|total stockholders.? equity|total shareholders.? equity|total members.? equity|total partners.? capital"
# The documents to expect of a fund's type.
EXPECTED_DOCUMENTS = {
    "bdc": "lp_statement", "etf": "lp_statement", "public": "lp_statement", "hedge_fund": "transparency_report,lp_statement",
    "private_equity": "financial_statements,lp_statement", "venture_capital": "financial_statements,lp_statement", "private_credit": "financial_statements,lp_statement",
}
# Spellings of fund types, and the groups that a dashboard shows.
FUND_TYPES = {
    "private_equity": ["private_equity", "private equity", "pe"], "venture_capital": ["venture_capital", "venture capital", "vc"], "hedge_fund": ["hedge_fund", "hedge fund", "hedge"],
    "private_credit": ["private_credit", "private credit", "credit"], "bdc": ["bdc"], "etf": ["etf", "etf / mutual"], "mutual_fund": ["mutual_fund", "mutual fund", "mutual"], "public": ["public"],
}
FUND_GROUPS = {
    "private_equity": ["pe", "private_equity", "private equity"], "venture_capital": ["vc", "venture_capital", "venture capital"], "private_credit": ["credit", "private_credit", "private credit"],
    "hedge_fund": ["hedge", "hedge_fund", "hedge fund"], "public_market": ["etf", "mutual_fund", "public", "13f"], "bdc": ["bdc"],
}


def is_date_like(text: Column) -> Column:
    """Whether a text is of the form month/day/year or month/year."""
    return F.trim(text).rlike(r"^\d{1,2}/(\d{1,2}/)?\d{4}$")


def schedule_date(text: Column) -> Column:
    """The date of a schedule as yyyy-MM-dd: the first year behind the first listed quarter end that occurs."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.concat(F.regexp_extract(low, p, 1), F.lit("-" + day))) for p, day in QUARTER_ENDS.items()])


def fund_name(text: Column, file: Column) -> Column:
    """The longest name in capitals early in the text, else one from the file's name."""
    pattern = r"([A-Z][A-Z\s&]+(?:CORPORATION|CORP\.|INC\.|LLC|LP|CAPITAL|PARTNERS))"
    found = F.regexp_extract_all(F.substring(text, 1, 5000), F.lit(pattern), F.lit(1))
    longest = F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    plain = F.regexp_replace(F.regexp_replace(file, "_10K_|_", " "), r"\.html", "")
    return F.coalesce(F.nullif(F.trim(longest), F.lit("")), F.concat(F.element_at(F.split(F.trim(plain), r"\s+"), 1), F.lit(" Capital")))


def report_date(text: Column, file: Column) -> Column:
    """The last day of the year before the one in the file's name, else of the year that the text names; else null."""
    year = F.nullif(F.regexp_extract(file, r"(\d{4})", 1), F.lit("")).cast("int") - 1
    start = F.substring(text, 1, 10000)
    told = [F.nullif(F.regexp_extract(start, p, 1), F.lit("")).cast("int") for p in (r"(?i)December\s*31,\s*(\d{4})", r"(\d{4})-12-31", r"(?i)fiscal year ended.*?(\d{4})")]
    return F.concat(F.coalesce(year, *told).cast("string"), F.lit("-12-31"))


def net_assets(cells: Column) -> Column:
    """The first amount over 100 in a balance sheet row of net assets; null for other rows."""
    text = F.lower(F.array_join(cells, " "))
    plain = F.transform(cells, lambda c: F.regexp_replace(c, r"[$,\s\u00a0]", "").try_cast("double"))
    amount = F.get(F.filter(plain, lambda v: v > 100), 0)
    return F.when(text.rlike(NET_ASSETS) & ~text.contains("liabilities and"), amount)


def iso_date(text: Column) -> Column:
    """A date in one of the usual forms as yyyy-MM-dd; anything else stays."""
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyyMMdd", "d-MMM-yyyy")
    return F.coalesce(*[F.date_format(F.try_to_timestamp(F.trim(text), F.lit(f)), "yyyy-MM-dd") for f in forms], text)


def json_answer(text: Column, schema: str) -> Column:
    """A provider's answer as a struct, without the fence around it; null if it is no JSON object."""
    body = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def expected_documents(fund_type: Column) -> Column:
    """array<string>: the documents to look for, all kinds where the type says nothing."""
    listed = F.create_map(*[F.lit(x) for kv in EXPECTED_DOCUMENTS.items() for x in kv])
    return F.split(F.coalesce(F.element_at(listed, F.lower(fund_type)), F.lit("financial_statements,lp_statement,transparency_report")), ",")


def _grouped(text: Column, groups: dict[str, list[str]], other: str) -> Column:
    spelled = F.create_map(*[F.lit(x) for name, many in groups.items() for spelling in many for x in (spelling, name)])
    return F.coalesce(F.element_at(spelled, text), F.lit(other))


def fund_type(text: Column) -> Column:
    """The type that a spelling stands for, else "unknown"."""
    return _grouped(F.trim(F.lower(text)), FUND_TYPES, "unknown")


def fund_group(text: Column) -> Column:
    """The group that a dashboard shows a type in, else "other"."""
    return _grouped(F.lower(text), FUND_GROUPS, "other")


def token_estimate(name: Column, description: Column, nodes: Column | int) -> Column:
    """Tokens of a call to classify one company."""
    quarter = lambda c: F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)
    return (100 + F.greatest(F.lit(1), quarter(name)) + quarter(description) + 7 * (F.lit(nodes) if isinstance(nodes, int) else nodes)).cast("long")
