"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four base patterns (e-mail, IP address, card and phone number) that pass their checks.
Every token with a digit or an @ is an instance; its lexical patterns are the word before it, the two words before it
and the word behind it. Patterns and instances form a graph over the whole corpus, which is scored in turns: a
pattern's confidence is the sum of the scores of its distinct instances over what it extracts: those instances, all
other uses of its words in the corpus (counted over every text) and `prior`; it is 0 while that sum is below
`min_support`. An instance that is no seed scores one minus the product of (1 - confidence) over its patterns, so that
instances found in one turn support new patterns in the next. After `turns` turns, tokens of unseen instances in a
pattern of confidence `min_confidence` or more become spans of kind "id", if they have `min_digits` digits and
`min_size` code points at least.

Positions are code points, ends exclusive. Defined cases: null text counts as empty; repeated rows each give their
row; base spans of different kinds may overlap; a found token never overlaps a base span; texts and words are whole,
however long; columns of `docs` may have any name (base and spans are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import broadcast_if_small, free_names, materialize

KINDS = ("email", "ip", "card", "phone", "id")

# The base patterns, with possessive repeats where giving back cannot help, so that no text takes quadratic time:
# a match starts where its first run of characters does, or where the last match ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_BLANK = "\t\n\x0b\x0c\r"
_PART = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(widths: Column, i: Column, block: Column, sums: Column) -> Column:
    """Sum of the first i widths, from sums of blocks."""
    full = F.floor(i / block).cast("int")
    add = lambda a, x: a + x
    rest = F.slice(widths, full * block + 1, i - full * block)
    return F.aggregate(F.slice(sums, F.lit(1), full), F.lit(0), add) + F.aggregate(rest, F.lit(0), add)


def _spaced(text: Column) -> Column:
    return F.translate(text, _BLANK, " " * len(_BLANK))


def _contexts(before: Column, behind: Column) -> Column:
    """array<string>: the patterns of a token between two pieces without tokens; words in lower case."""
    before, behind = F.rtrim(_spaced(before)), F.ltrim(_spaced(F.coalesce(behind, F.lit(""))))
    one, two, after = F.substring_index(before, " ", -1), F.substring_index(before, " ", -2), F.substring_index(behind, " ", 1)
    pair = F.when(two.rlike("^[^ ]+ [^ ]+$"), F.concat(two, F.lit(" _")))
    found = F.array(F.when(one != "", F.concat(one, F.lit(" _"))), pair, F.when(after != "", F.concat(F.lit("_ "), after)))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), F.lower)


def _matches(text: Column, pattern: str, seen: Column, contexts: bool = False) -> Column:
    """array<struct<start, end, match, patterns>> of a pattern's matches, from the matches and the pieces between.

    `patterns` are empty unless `contexts`. Where `seen` is false there is no match, and no search.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(r: Column) -> Column:
        widths = F.zip_with(r["p"], r["m"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        return _bound(F.struct(r["m"].alias("m"), r["p"].alias("p"), widths.alias("w"), F.greatest(F.lit(1), F.floor(F.sqrt(F.size(r["m"])))).cast("int").alias("b")), summed)

    def summed(r: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(r["m"]) / r["b"]).cast("int"))
        sums = F.transform(blocks, lambda k: F.aggregate(F.slice(r["w"], k * r["b"] + 1, r["b"]), F.lit(0), lambda a, x: a + x))
        return _bound(F.struct(*[r[c].alias(c) for c in "mpwb"], sums.alias("s")), listed)

    def listed(r: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            piece = F.get(r["p"], i)
            start = _upto(r["w"], i, r["b"], r["s"]) + F.length(piece)
            patterns = _contexts(piece, F.get(r["p"], i + 1)) if contexts else F.array().cast("array<string>")
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), patterns.alias("patterns"))

        return F.when(F.size(r["m"]) > 0, F.transform(r["m"], one))

    kind = "array<struct<start:int,end:int,match:string,patterns:array<string>>>"
    return F.coalesce(F.when(seen, _bound(found, placed)), F.array()).cast(kind)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _checked(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(_PART))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _base(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    plans = {"email": (_EMAIL, F.contains(text, F.lit("@"))), "ip": (_IP, digit & F.contains(text, F.lit("."))), "card": (_CARD, digit), "phone": (_PHONE, F.contains(text, F.lit("+")))}
    passes = lambda kind: lambda s: _checked(kind, s["match"])
    return {k: F.filter(_matches(text, pattern, seen), passes(k)) for k, (pattern, seen) in plans.items()}


def _spans(found: Column, number: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def _runs(spans: Column) -> Column:
    """array<struct<low, high, spans>>: ordered spans in runs of about the root of their number, with the bounds of each."""
    size = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(spans)))).cast("int")
    starts = F.filter(F.sequence(F.lit(1), F.size(spans) + 1), lambda i: ((i - 1) % size == 0) & (i <= F.size(spans)))
    bounded = lambda run: F.struct(run[0]["start"].alias("low"), F.array_max(F.transform(run, lambda s: s["end"])).alias("high"), run.alias("spans"))
    return F.transform(starts, lambda i: _bound(F.slice(spans, i, size), bounded))


def _meets(token: Column, runs: Column) -> Column:
    """Whether a token overlaps a span: only runs that reach over it are searched, so a text of n spans takes n times root n."""
    overlaps = lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"])
    return F.exists(runs, lambda r: (r["low"] < token["end"]) & (token["start"] < r["high"]) & F.exists(r["spans"], overlaps))


def scan(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The columns of `docs` but the text, and the names of three more: a row number, base spans (start, kind number,
    end) in order, and tokens (start, end, match, patterns, seed) that hold a digit or an @."""
    carried = [c for c in docs.columns if c not in (text_col, "base", "spans")]
    names = free_names([*carried, "spans"], "text", "row", "base", "tokens")
    given, row, spans, found = names
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in carried]
    base = _base(F.col(given))
    with_base = docs.select(*kept, text.alias(given)).select(
        *kept,
        F.array_sort(F.concat(*[_spans(base[k], i) for i, k in enumerate(KINDS[:4])])).alias(spans),
        _matches(F.col(given), _TOKEN, F.col(given).rlike("[0-9@]"), contexts=True).alias(found),
    )
    token = lambda t, runs: F.struct(*[t[c].alias(c) for c in ("start", "end", "match", "patterns")], _meets(t, runs).alias("seed"))
    seeded = _bound(_runs(F.col(spans)), lambda runs: F.transform(found, lambda t: token(t, runs)))
    return with_base.select(*kept, F.monotonically_increasing_id().alias(row), spans, seeded.alias(found)), names[1:]


def _words_of(pattern: Column) -> Column:
    """The words of a pattern, without the place of the instance."""
    return F.trim(F.regexp_replace(pattern, r"^_ | _$", ""))


def count_uses(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """words and uses: how often each word or pair of neighbouring words of `wanted` stands in the texts (text)."""
    words = F.split(F.trim(_spaced(F.lower("text"))), " +")
    neighbours = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    every = texts.filter("text is not null").select(F.explode(_bound(words, lambda w: F.concat(w, neighbours(w)))).alias("words"))
    return every.join(broadcast_if_small(wanted, "words"), "words", "left_semi").groupBy("words").agg(F.count("*").alias("uses"))


def score_patterns(tokens: DataFrame, texts: DataFrame, *, turns: int = 3, min_support: float = 3.0, prior: float = 1.0) -> DataFrame:
    """pattern and confidence of the patterns with support, from tokens (patterns, match, seed) and texts (text) of the
    whole corpus."""
    edges = tokens.select(F.explode("patterns").alias("pattern"), "match", "seed").groupBy("pattern", "match").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "personal-edges")
    able = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("n")).filter(F.col("instances") >= min_support)
    able = materialize(able.withColumn("words", _words_of(F.col("pattern"))), "personal-able")
    uses = count_uses(texts, materialize(able.select("words").distinct(), "personal-words"))
    other = F.greatest(F.lit(0), F.coalesce("uses", F.lit(0)) - F.col("n"))
    able = materialize(able.join(uses, "words", "left").select("pattern", (F.col("instances") + other + prior).alias("extracted")), "personal-extracted")
    able = broadcast_if_small(able, "pattern")
    live = materialize(edges.join(able, "pattern").select("pattern", "match", "seed", "extracted"), "personal-live")
    scores = None
    for turn in range(turns):
        score = F.when(F.col("seed"), 1.0)
        known = live if scores is None else live.join(scores, "match", "left")
        score = score.otherwise(F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0)))
        support = F.round(F.sum(score), 9)
        patterns = known.groupBy("pattern").agg(support.alias("support"), F.max("extracted").alias("extracted")).filter(F.col("support") >= min_support)
        patterns = materialize(patterns.select("pattern", (F.col("support") / F.col("extracted")).alias("confidence")), "personal-patterns")
        if turn < turns - 1:
            rated = live.filter(~F.col("seed")).join(broadcast_if_small(patterns, "pattern"), "pattern")
            scores = rated.groupBy("match").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))).alias("left"))
            scores = materialize(scores.select("match", F.round(1 - F.exp("left"), 9).alias("score")), "personal-scores")
    return patterns


def find_personal_data(
    docs: DataFrame,
    *,
    text_col: str = "text",
    turns: int = 3,
    min_support: float = 3.0,
    prior: float = 1.0,
    min_confidence: float = 0.6,
    min_digits: int = 3,
    min_size: int = 6,
) -> DataFrame:
    """The columns of `docs` but the text, and base (base spans) and spans (all spans): arrays of (start, kind
    number, end) in order."""
    scanned, (row, base, found) = scan(docs, text_col=text_col)
    scanned = materialize(scanned, "personal-scan")
    tokens = scanned.select(F.col(row).alias("row"), F.explode(found).alias("t")).select("row", "t.*")
    patterns = score_patterns(tokens, docs.select(F.col(f"`{text_col}`").alias("text")), turns=turns, min_support=min_support, prior=prior)
    good = materialize(patterns.filter(F.col("confidence") >= min_confidence).select("pattern"), "personal-good")
    shaped = tokens.filter(~F.col("seed") & (F.length("match") >= min_size) & (F.regexp_count("match", F.lit("[0-9]")) >= min_digits))
    unseen = shaped.select("row", "start", "end", F.explode("patterns").alias("pattern")).join(broadcast_if_small(good, "pattern"), "pattern", "left_semi")
    more = unseen.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("more"))
    (extra,) = free_names([*scanned.columns, "spans"], "more")
    joined = scanned.join(broadcast_if_small(materialize(more, "personal-more"), 256).withColumnsRenamed({"row": row, "more": extra}), row, "left")
    carried = [c for c in scanned.columns if c not in (row, base, found)]
    every = F.array_sort(F.concat(F.col(base), F.coalesce(F.col(extra), F.array().cast(scanned.schema[base].dataType))))
    return joined.select(*[F.col(f"`{c}`") for c in carried], F.col(base).alias("base"), every.alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(id_col, *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
