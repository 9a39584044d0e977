"""Information-theoretic sanitisation of personal data, in DataFrame operations alone.

Direct identifiers (mail and IP addresses, card and phone numbers) are found by
patterns. The values found are the protected entities. Terms that stand near an
entity are counted with it over the distinct lines of the corpus; a term's disclosure is
its pointwise mutual information with the entity, in bits, and the share of
the term's lines that name the entity. A term above both thresholds gives the
entity away wherever it stands: it is generalised, or removed where it nearly
always means that entity.

Patterns are written so that each text is scanned in linear time; possessive
repeats and look-behinds change nothing about which spans match.

Edge cases: a null text has no spans and stays null; null ids and repeated rows are
treated like any other, spans of terms are attached by id and text; copies of a
line count once; an empty table gives an empty one; other columns pass through
unless they are named like a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

# The patterns of the contract.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

NEAR_WORDS = 10
# Matches of a text whose places are found together.
PIECE = 512
# Code points of a text that are cut out together.
STRETCH = 4096
MIN_TERM_LENGTH = 4
MIN_TOGETHER = 3
MIN_BITS = 6.0
MIN_SHARE = 0.9
REMOVE_SHARE = 0.98
NO_WORD = r"[^\p{L}\p{N}]+"

SPAN = "array<struct<start:int,kind:int,end:int,label:string>>"


# ---- direct identifiers -----------------------------------------------------------


def _octet(x: Column) -> Column:
    return x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(backwards, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _octet),
    "card": lambda x: F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(False),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern; most texts have none."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    hint = HINTS[kind]
    return hits if hint is None else F.when(F.contains(text, F.lit(hint)), hits).otherwise(F.array().cast("array<string>"))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def _scan(values: Column, first: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of ``first`` and all values up to each place."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _bound(join(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc.out, F.array(at)).alias("out")))

    return F.aggregate(values, start, step, lambda acc: acc.out)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals, or running maxima, of an array of counts; 0 is neutral for ``join``.

    An array that grows value by value is copied each time, so only pieces of ``PIECE``
    values and one total for each piece are gone through in that way.
    """
    zero = F.lit(0)

    def lifted(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, join))
        before = _bound(_scan(totals, zero, join), lambda ends: F.concat(F.array(zero), F.slice(ends, F.lit(1), F.size(ends) - 1)))
        return F.flatten(F.zip_with(pieces, before, lambda p, at: _scan(p, at, join)))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(PIECE))
        return _bound(F.transform(starts, lambda i: F.slice(v, i, F.lit(PIECE))), lifted)

    return _bound(values, cut)


def _places(hits: Column, between: Column) -> Column:
    """Where each match starts, in code points: the lengths before it added up."""
    n = F.size(hits)
    before = F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), n - 1), F.length))
    gaps = F.transform(F.slice(between, F.lit(1), n), F.length)
    return running(F.zip_with(gaps, before, lambda a, b: a + b), lambda a, b: a + b)


def _spans(hits: Column, between: Column, kind: int, valid: Callable[[Column], Column], label: Callable[[Column], Column]) -> Column:
    make = lambda h, at: F.when(
        valid(h), F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(h)).alias("end"), label(h).alias("label"))
    )
    spans = F.filter(F.zip_with(hits, _places(hits, between), make), lambda s: s.isNotNull())
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__email`` and so on: the valid spans of each kind."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({f"__hits_{k}": _found(value, k) for k in KINDS})
    spans = {
        f"__{k}": _spans(F.col(f"__hits_{k}"), F.split(value, PATTERNS[k], -1), i, VALID[k], lambda h, k=k: F.lit(LABELS[k]))
        for i, k in enumerate(KINDS)
    }
    return found.withColumns(spans).drop(*[f"__hits_{k}" for k in KINDS])


# ---- terms that give entities away ------------------------------------------------


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.explode(F.split(text, "\n", -1)).alias("line"))
    return rows.withColumn("lh", F.xxhash64("line"))


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, NO_WORD, -1), lambda w: F.length(w) >= MIN_TERM_LENGTH)


def entity_places(lines: DataFrame) -> DataFrame:
    """``lh, entity, near``: each entity's lines and the words near it."""
    places = None
    for kind in KINDS:
        held = lines.withColumn("hits", _found(F.col("line"), kind)).where(F.size("hits") > 0)
        n = F.size("hits")
        between = F.split("line", PATTERNS[kind], -1)
        met = held.withColumn("between", between).select(
            "lh", F.explode(F.arrays_zip("hits", F.slice("between", F.lit(1), n).alias("left"), F.slice("between", F.lit(2), n).alias("right"))).alias("m")
        )
        met = met.where(VALID[kind](F.col("m.hits")))
        left, right = F.filter(F.split("m.left", NO_WORD, -1), lambda w: w != ""), F.filter(F.split("m.right", NO_WORD, -1), lambda w: w != "")
        near = F.concat(F.slice(F.reverse(left), 1, NEAR_WORDS), F.slice(right, 1, NEAR_WORDS))
        value = F.lower("m.hits") if kind == "email" else _digits(F.col("m.hits"))
        part = met.select("lh", F.xxhash64(F.lit(kind), value).alias("entity"), F.array_distinct(near).alias("near"))
        places = part if places is None else places.unionByName(part)
    return places


def term_pairs(places: DataFrame, min_together: int, min_share: float) -> DataFrame:
    """``term, entity, together``: on how many distinct lines a term stands near an entity.

    Terms that even the lines around entities show with others too often to reach
    ``min_share`` are left out: common words go before they are looked up anywhere.
    """
    pairs = places.select("lh", "entity", F.explode("near").alias("term"))
    pairs = pairs.where(F.length("term") >= MIN_TERM_LENGTH).distinct()
    together = pairs.groupBy("term", "entity").agg(F.count("*").alias("together")).where(F.col("together") >= min_together)
    around = pairs.select("term", "lh").distinct().groupBy("term").agg(F.count("*").alias("around"))
    return together.join(around, "term").where(F.col("together") >= min_share * F.col("around")).drop("around")


def disclosing_terms(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_together: int = MIN_TOGETHER,
    min_bits: float = MIN_BITS,
    min_share: float = MIN_SHARE,
    remove_share: float = REMOVE_SHARE,
) -> DataFrame:
    """``id, th, terms``: the terms to treat in a document (``th`` is its text's hash), each with ``drop``."""
    lines = _lines(docs, id_col, text_col).select("lh", "line")
    places = written(entity_places(lines), "disclosure-places")
    pairs = written(term_pairs(places, min_together, min_share), "disclosure-pairs")
    candidates = written(pairs.select("term").distinct(), "disclosure-terms")
    # Where candidate terms stand. Spark broadcasts the candidates if their table is small.
    words = _lines(docs, id_col, text_col).select("id", "th", "lh", F.explode(F.array_distinct(_terms(F.col("line")))).alias("term"))
    seen = written(words.join(candidates, "term"), "disclosure-seen")
    per_term = seen.groupBy("term").agg(F.count_distinct("lh").alias("lines"))
    # All counts are of distinct lines: the entity's, the term's and the corpus'.
    entity = places.select("entity", "lh").distinct().groupBy("entity").agg(F.count("*").alias("entity_lines"))
    all_lines = lines.select("lh").distinct().count()
    share = F.col("together") / F.col("lines")
    bits = F.log2(F.col("together") * F.lit(float(all_lines)) / (F.col("lines") * F.col("entity_lines")))
    told = pairs.join(per_term, "term").join(entity, "entity").where((share >= min_share) & (bits >= min_bits))
    flagged = written(told.groupBy("term").agg((F.max(share) >= remove_share).alias("drop")), "disclosure-flagged")
    return seen.join(flagged, "term").groupBy("id", "th").agg(F.collect_set(F.struct("term", "drop")).alias("terms"))


def _term_spans(text: Column, hits: Column, terms: Column) -> Column:
    drop = lambda h: F.exists(terms, lambda t: (t.term == h) & t["drop"])
    label = lambda h: F.when(drop(h), F.lit("")).otherwise(F.lit(LABELS["term"]))
    return _spans(hits, F.split(text, F.col("__pattern"), -1), len(KINDS), lambda h: F.lit(True), label)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: structs of start, kind, end and label, by start and kind."""
    docs = docs.drop("base_spans", "all_spans")
    terms = written(disclosing_terms(docs, id_col, text_col), "disclosure-by-text")
    terms = terms.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("terms").alias("__terms"))
    joined = docs.join(terms, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left").drop("__id", "__th")
    based = with_base_spans(joined, text_col)
    base = F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS]))
    # One pattern of the document's own terms, as whole words.
    quoted = F.array_join(F.transform("__terms", lambda t: F.concat(F.lit(r"\Q"), t.term, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    out = based.withColumns({"base_spans": base, "__pattern": F.when(F.size("__terms") > 0, pattern)})
    out = out.withColumn("__hits", F.when(F.col("__pattern").isNotNull(), F.regexp_extract_all(F.col(text_col), F.col("__pattern"), F.lit(0))))
    more = F.when(F.size("__hits") > 0, _term_spans(F.col(text_col), F.col("__hits"), F.col("__terms"))).otherwise(F.array().cast(SPAN))
    apart = F.filter(more, lambda t: ~F.exists("base_spans", lambda b: (b.start < t.end) & (t.start < b.end)))
    out = out.withColumn("all_spans", F.array_sort(F.concat("base_spans", apart)))
    return out.drop("__terms", "__pattern", "__hits", *[f"__{k}" for k in KINDS])


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its label; overlapping spans become one, labelled as the first."""
    found = find_spans(docs, id_col, text_col)
    text = F.col(text_col)
    # A span's text goes from where the ones before it have ended; one that lies within them adds nothing.
    ends = running(F.transform("all_spans", lambda s: s.end), lambda a, b: F.greatest(a, b))
    many = F.size("all_spans") > 0
    cut = found.withColumn("__ends", F.when(many, ends))
    before = F.concat(F.array(F.lit(0)), F.slice("__ends", F.lit(1), F.size("__ends") - 1))
    cut = cut.withColumn("__before", F.when(many, before))
    joined = F.zip_with("all_spans", "__before", lambda s, at: F.struct(at.alias("lead"), s.start.alias("start"), s.label.alias("label")))
    # A place in a string is found by counting from its start: stretches of equal length keep that short.
    cut = cut.withColumn("__stretches", F.when(many, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))

    def part(start: Column, end: Column) -> Column:
        first, last = F.floor(start / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
        own = F.array_join(F.slice("__stretches", first + 1, last - first + 1), "")
        return F.substring(own, start - first * STRETCH + 1, end - start)

    kept = F.transform(joined, lambda s: F.when(s.start >= s.lead, F.concat(part(s.lead, s.start), s.label)).otherwise(F.lit("")))
    rest = part(F.element_at("__ends", -1), F.length(text))
    new = F.when(F.col("__ends").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    return cut.withColumn(text_col, new).drop("__ends", "__before", "__stretches", "base_spans", "all_spans")
