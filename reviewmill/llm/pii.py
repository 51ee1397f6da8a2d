"""Personal data by fixed forms, and by contexts learnt from them.

Four kinds have a fixed form (e-mail address, IP address, payment card, phone number). Their spans
are the base, and the seeds of a bootstrap: the two words to the left of a span, or the one word
that starts its line, are a lexical pattern, the text of the span an instance. Other tokens with digits that look like identifiers
are instances too, with the patterns they stand in. Over this graph scores go back and forth:

* the score of a pattern is the mean trust in its distinct instances, with ``PRIOR`` untrusted
  ones added;
* the trust in a seed is 1, in any other instance the probability that at least one of its
  patterns is right.

Patterns that reach ``MIN_SCORE`` with at least ``MIN_INSTANCES`` distinct instances, as many of
them seeds as ``MIN_SEEDS``, mark the identifiers that stand in them, wherever that is. Identifiers
so marked with a trust of at least ``MIN_TRUST`` support other patterns in the next stage, which
need no seeds if ``MIN_INSTANCES`` of their instances are seeds or marked. Stages follow each other
as long as one trusts further patterns, so a context is reached over any number of others.

Only DataFrame functions are used. A text is read once; its spans are arrays of its own row.
Distinct pairs of pattern and instance are counted before any join, so a copied document counts
once, and a pattern or instance with a third of all mentions is one row per task. Joins take the
smaller side by measured size, else they shuffle and adaptive execution splits hot keys.

Positions come from cutting a text at the matches: lengths of gaps and matches add up. The forms
are written with possessive quantifiers, so a match takes time in proportion to its text. Texts
with many spans are not walked again for each: what stands left of a span or between two is read
from pages of the text, and running sums are taken in two levels, so ``n`` spans take ``n ** 1.5``
copies of a number at most.

Defined results
---------------
* Text NULL is empty: no spans. Very long texts and texts with many spans are treated as others.
* Identifiers found in contexts have six characters and three digits at least.
* Rows with NULL or repeated keys are treated one by one; equal rows have equal spans.
* Words of a context and the white space between them may have any length; words that are alike in
  their last ``WORD_CHARS`` characters are the same. A span with no word before it has no context.
* A found identifier never overlaps a base span. Equal starts are in the order of the kinds.
* An empty table, or no seeds, gives base results only. Other columns are ignored or kept as they
  are by :func:`mask_documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm.common import stored
from reviewmill.operators.joins import sized
from reviewmill.session import cut_lineage

PRIOR = 1.0
ROUNDS = 3
MIN_SCORE = 0.5
MIN_INSTANCES = 4
MIN_SEEDS = 3
MIN_TRUST = 0.5
CONTEXT_CHARS = (64, 4096)  # looked at before the whole text to the left
WORD_CHARS = 64
FOUND = "id"
PAGE_CHARS = 1024

SPAN = "array<struct<start:bigint,stop:bigint,kind:int,text:string>>"
MENTION = "array<struct<start:bigint,stop:bigint,patterns:array<string>,instance:bigint>>"


class Kind(NamedTuple):
    name: str
    form: str
    hint: str  # what every text with a match holds


# The forms of the contract. A run can only match from its start or from the end of
# the match before; said so, no character is tried twice.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
IDENTIFIER = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+"
# Words to the left of a span. Words start at white space only, so no character is
# tried twice.
OPENING = r"(?<!\S)[\"'(<\[]\z"
LAST_WORDS = r"(?:(?<!\S)(\S++)(\s++)(?=\S))?+(?<!\S)(\S++)(\s*+)$"
WHOLE_WORDS = r"(?<=\s)\S++\s++\S++\s*+$"
LINE_BREAK = r"[\n\r]"
PAGE = rf"(?s).{{1,{PAGE_CHARS}}}"
HEAD = r"(?<!\S)\S++(?:\s++\S++){0,2}\s*+\z"
SHORTENED = (
    (r"(?<!\s)[^\S\n\r]*+[\n\r]\s*+", "\n"),
    (r"[^\S\n\r]{2,}+", " "),
    (r"[0-9]++", "0"),
    (rf"(?<!\S)(?=\S{{{2 * WORD_CHARS + 1}}})\S+(\S{{{2 * WORD_CHARS}}})(?!\S)", "$1"),
)
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, is divisible by 10."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise((2 * d) % 10 + F.floor(d / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _fits(kind: int, text: Column) -> Column:
    """What a match must fulfil beyond its form."""
    name, length = KINDS[kind].name, F.length(_digits(text))
    if name == "ip":
        return text.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if name == "card":
        return F.when(length.between(12, 19), _luhn(_digits(text))).otherwise(False)
    return length.between(9, 15) if name == "phone" else F.lit(True)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas within refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of the numbers up to each, in chunks of about the root of their count."""
    none = F.array().cast("array<bigint>")

    def inside(chunk: Column) -> Column:
        def step(done: Column, value: Column) -> Column:
            last = F.element_at(done, -1)
            return F.concat(done, F.array(F.when(F.size(done) == 0, value).otherwise(combine(last, value))))

        return F.aggregate(chunk, none, step)

    def joined(chunks: Column) -> Column:
        ends = inside(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return _with(
            ends,
            lambda e: F.flatten(
                F.transform(
                    chunks,
                    lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda v: combine(F.get(e, i - 1), v))),
                )
            ),
        )

    def cut(array: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(array))).cast("int")
        starts = F.sequence(F.lit(1), F.size(array), width)
        return _with(F.transform(starts, lambda at: inside(F.slice(array, at, width))), joined)

    return _with(values, lambda array: F.when(F.size(array) == 0, none).otherwise(cut(array)))


def _pages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PAGE), F.lit(0))


def _between(pages: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to before ``stop``, read from the pages they are on."""
    first = F.floor(start / PAGE_CHARS).cast("int")
    count = F.floor((stop - 1) / PAGE_CHARS).cast("int") - first + 1
    part = F.array_join(F.slice(pages, first + 1, count), "")
    part = F.substring(part, (start - first * PAGE_CHARS + 1).cast("int"), (stop - start).cast("int"))
    return F.when(stop > start, part).otherwise("")


def _matches(text: Column, form: str, kind: int) -> Column:
    """Every match with its place in code points."""

    def placed(cut: Column) -> Column:
        gaps, found = cut["gaps"], cut["found"]
        lengths = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, t: (F.length(g) + F.length(t)).cast("bigint")
        )
        stops = _running(lengths, lambda before, length: before + length)
        return F.zip_with(
            stops,
            found,
            lambda stop, t: F.struct(
                (stop - F.length(t)).alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), t.alias("text")
            ),
        )

    gaps, found = F.split(text, form), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return _with(F.struct(gaps.alias("gaps"), found.alias("found")), placed)


def _spans_of(text: Column, kind: int) -> Column:
    found = F.filter(_matches(text, KINDS[kind].form, kind), lambda s: _fits(kind, s["text"]))
    hint = KINDS[kind].hint
    possible = F.contains(text, F.lit(hint)) if hint else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(possible, found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms by start, then kind."""
    ordered = F.transform(
        F.concat(*[_spans_of(text, number) for number in range(len(KINDS))]),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["text"].alias("text")),
    )
    return F.array_sort(ordered)


def _left(pages: Column, heads: Column, start: Column) -> Column:
    """The last two words left of a place with the white space after each, or the one there is.

    Words and gaps may have any length: where the nearest characters do not show both words whole,
    more are taken, in the end the page up to there after the head of its page.
    """
    first = F.floor(start / PAGE_CHARS).cast("int")
    found = F.concat(F.get(heads, first), _between(pages, first * F.lit(PAGE_CHARS).cast("bigint"), start))
    found = F.regexp_extract(F.regexp_replace(found, OPENING, ""), LAST_WORDS, 0)
    for width in reversed(CONTEXT_CHARS):
        before = F.regexp_replace(_between(pages, F.greatest(start - width, F.lit(0).cast("bigint")), start), OPENING, "")
        words = F.regexp_extract(before, LAST_WORDS, 0)
        found = F.when((start <= width) | before.rlike(WHOLE_WORDS), words).otherwise(found)
    return found


def _heads(pages: Column) -> Column:
    """For every page the last three words before it (one may be an opening bracket), with their gaps.

    Kept is what patterns tell apart: of a gap whether it holds a line break, of a run of digits
    that it is there, of a word its last ``2 * WORD_CHARS`` characters.
    """

    def step(done: Column, page: Column) -> Column:
        read = F.regexp_extract(F.concat(F.element_at(done, -1), page), HEAD, 0)
        for form, kept in SHORTENED:
            read = F.regexp_replace(read, form, kept)
        return F.concat(done, F.array(read))

    return F.aggregate(pages, F.array(F.lit("")), step)


def _word(word: Column) -> Column:
    return F.right(F.regexp_replace(F.lower(word), r"[0-9]+", "0"), F.lit(WORD_CHARS))


def _patterns(left: Column) -> Column:
    """The two words of :func:`_left` in lower case, digits alike; a missing one is a line break.

    Where a line break parts them, a label that starts a line and a wrapped line look the same, so
    there are two patterns: with the word of the line before, and as the start of a line.
    """
    first, gap, last, tail = (F.regexp_extract(left, LAST_WORDS, n) for n in range(1, 5))
    both = F.concat(_word(first), F.lit(" "), _word(last))
    alone = F.concat(F.lit("\n "), _word(last))
    parted = gap.rlike(LINE_BREAK) & ~tail.rlike(LINE_BREAK)
    return (
        F.when(left == "", F.array().cast("array<string>"))
        .when(first == "", F.array(alone))
        .when(parted, F.array(both, alone))
        .otherwise(F.array(both))
    )


def _mentions(text: Column, spans: Column) -> Column:
    """Tokens that look like identifiers, outside of the base spans, with their patterns."""
    tokens = F.when(text.rlike("[0-9]"), _matches(text, IDENTIFIER, len(KINDS))).otherwise(F.array().cast(SPAN))
    likely = F.filter(tokens, lambda t: F.length(_digits(t["text"])) >= 3)
    return _in_context(text, _outside(_instances(likely), spans))


def _instances(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.xxhash64(s["text"]).alias("instance")),
    )


def _outside(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap no span: none of the spans that start before their end reaches them."""

    def event(at: Column, is_span: int, other: Column, instance: Column) -> Column:
        return F.struct(
            at.alias("at"), F.lit(is_span).alias("is_span"), other.alias("other"), instance.alias("instance")
        )

    ends = F.transform(tokens, lambda t: event(t["stop"], 0, t["start"], t["instance"]))
    starts = F.transform(spans, lambda s: event(s["start"], 1, s["stop"], F.lit(0).cast("bigint")))

    def free(events: Column) -> Column:
        reach = _running(
            F.transform(events, lambda e: F.when(e["is_span"] == 1, e["other"]).otherwise(F.lit(0).cast("bigint"))),
            lambda a, b: F.greatest(a, b),
        )
        told = F.zip_with(
            events,
            reach,
            lambda e, r: F.when(
                (e["is_span"] == 0) & (r <= e["other"]),
                F.struct(e["other"].alias("start"), e["at"].alias("stop"), e["instance"].alias("instance")),
            ),
        )
        return F.filter(told, lambda t: t.isNotNull())

    return _with(F.sort_array(F.concat(ends, starts)), free)


def _in_context(text: Column, spans: Column) -> Column:
    """``spans`` (start, stop, instance) with their patterns."""

    def placed(read: Column) -> Column:
        lefts = F.transform(
            read["spans"],
            lambda s: F.struct(s.alias("span"), _left(read["pages"], read["heads"], s["start"]).alias("left")),
        )
        return F.transform(
            lefts,
            lambda s: F.struct(
                s["span"]["start"].alias("start"),
                s["span"]["stop"].alias("stop"),
                _patterns(s["left"]).alias("patterns"),
                s["span"]["instance"].alias("instance"),
            ),
        )

    def read(known: Column) -> Column:
        paged = _with(
            _pages(text), lambda p: F.struct(p.alias("pages"), _heads(p).alias("heads"), known.alias("spans"))
        )
        return F.when(F.size(known) == 0, F.array().cast(MENTION)).otherwise(_with(paged, placed))

    return _with(spans, read)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, hash of the text, base ``spans``, ``seeds`` and ``mentions`` of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spanned = rows.withColumn("spans", base_spans(F.col("_text")))
    return spanned.select(
        "_key",
        F.xxhash64("_text").alias("_hash"),
        F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["stop"])).alias("spans"),
        _in_context(F.col("_text"), _instances(F.col("spans"))).alias("seeds"),
        _mentions(F.col("_text"), F.col("spans")).alias("mentions"),
    )


def trusted_patterns(
    scanned: DataFrame,
    rounds: int = ROUNDS,
    min_score: float = MIN_SCORE,
    min_instances: int = MIN_INSTANCES,
    min_seeds: int = MIN_SEEDS,
    min_trust: float = MIN_TRUST,
) -> DataFrame:
    """``pattern`` and ``score`` of the patterns that may mark identifiers.

    A stage is ``rounds`` rounds from the trust known at its start; it never loses a pattern of the
    stage before. The last one is the one that trusts no further pattern.
    """

    def edges_of(column: str, seed: bool) -> DataFrame:
        one = scanned.where(F.size(column) > 0).select(F.explode(column).alias("m"))
        return one.select(F.explode("m.patterns").alias("pattern"), "m.instance", F.lit(seed).alias("seed"))

    edges = edges_of("seeds", True).unionByName(edges_of("mentions", False))
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = cut_lineage(edges.withColumn("base", F.col("seed").cast("double")))
    # a pattern without a seed can only be reached over an instance, so all edges stay
    known = 0
    while True:
        trust = cut_lineage(edges.groupBy("instance").agg(F.max("base").alias("trust")))
        for _ in range(rounds):
            scored = edges.join(sized(trust), "instance").groupBy("pattern").agg(
                (F.sum("trust") / (F.count("*") + PRIOR)).alias("score"),
                F.count("*").alias("instances"),
                F.sum(F.col("seed").cast("int")).alias("seeds"),
                F.sum((F.col("base") > 0).cast("int")).alias("support"),
            )
            scores = cut_lineage(scored)
            wrong = F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))
            trust = cut_lineage(
                edges.join(sized(scores.select("pattern", "score")), "pattern")
                .groupBy("instance")
                .agg(F.when(F.max("seed"), 1.0).otherwise(F.greatest(F.max("base"), 1 - wrong)).alias("trust"))
            )
        enough = F.col("seeds") >= min_seeds
        if known:
            enough = enough | (F.col("support") >= min_instances)
        enough = enough & (F.col("score") >= min_score) & (F.col("instances") >= min_instances)
        found = cut_lineage(scores.where(enough).select("pattern", "score"))
        before, known = known, found.count()
        if known == before:
            return found
        marks = sized(found.select("pattern"))
        inside = edges.join(marks, "pattern", "left_semi").select("instance").distinct()
        sure = trust.where(F.col("trust") >= min_trust).join(inside, "instance").withColumnRenamed("trust", "sure")
        sure = sized(cut_lineage(sure))
        if edges.where("base = 0").join(marks, "pattern", "left_anti").join(sure, "instance", "left_semi").isEmpty():
            return found
        base = F.greatest("base", F.coalesce("sure", F.lit(0.0)))
        edges = cut_lineage(edges.join(sure, "instance", "left").select("pattern", "instance", "seed", base.alias("base")))


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """``_key``, ``_hash`` and ``more``, the spans of identifiers in trusted patterns."""
    mentions = scanned.where(F.size("mentions") > 0).select("_key", "_hash", F.explode("mentions").alias("m"))
    marked = mentions.withColumn("pattern", F.explode("m.patterns")).join(sized(patterns), "pattern", "left_semi")
    span = F.struct(F.col("m.start"), F.lit(len(KINDS)).alias("kind"), F.col("m.stop"))
    return marked.groupBy("_key", "_hash").agg(F.collect_set(span).alias("more"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit(FOUND))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def _with_found(scanned: DataFrame, **learning) -> DataFrame:
    """``scanned`` with ``all_spans``: base and found ones by start, then kind."""
    patterns = cut_lineage(trusted_patterns(scanned, **learning))
    more = sized(cut_lineage(discovered(scanned, patterns)))
    same = scanned["_key"].eqNullSafe(more["_key"]) & (scanned["_hash"] == more["_hash"])
    joined = scanned.join(more, same, "left").select(scanned["_key"], scanned["_hash"], "spans", "more")
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return joined.withColumn("all_spans", F.array_sort(F.concat("spans", F.coalesce("more", none))))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """Counts of base spans by kind, their digest, and all ``spans`` as text, of every row."""
    found = _with_found(stored(scan(docs, key, text), "scanned"), **learning)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(kinds, number))).cast("bigint").alias(f"n_{kind.name}")
        for number, kind in enumerate(KINDS)
    ]
    return found.select(
        F.col("_key").alias(key),
        *counts,
        F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("spans")).cast("bigint").alias("n_found"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with the name of the kind in place of every span; what overlaps is masked once."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS], F.lit(f"[{FOUND.upper()}]"))
    nowhere = F.lit(0).cast("bigint")

    def cut(read: Column) -> Column:
        def part(span: Column, number: Column) -> Column:
            before = F.when(number == 0, nowhere).otherwise(F.get(read["reach"], number - 1))
            kept = F.concat(_between(read["pages"], before, span["start"]), F.get(names, span["kind"]))
            return F.when(span["start"] >= before, kept).otherwise("")

        rest = _between(read["pages"], F.element_at(read["reach"], -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(spans, part), ""), rest)

    reach = _running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    read = F.struct(_pages(text).alias("pages"), reach.alias("reach"))
    return F.when(F.size(spans) > 0, _with(read, cut)).otherwise(text)


def mask_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **learning
) -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``n_chars`` (where there is one) counted anew."""
    scanned = stored(scan(docs, key, text), "scanned")
    found = _with_found(scanned, **learning).where(F.size("all_spans") > 0)
    found = sized(cut_lineage(found.select("_key", "_hash", "all_spans").distinct()))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash")
    )
    same = rows["_key"].eqNullSafe(found["_key"]) & (rows["_hash"] == found["_hash"])
    joined = rows.join(found, same, "left").select("row", "all_spans")
    clean = F.when(F.col("all_spans").isNull(), F.col("row")[text]).otherwise(masked(F.col("row")[text], F.col("all_spans")))
    columns = []
    for name in docs.columns:
        value = F.col("row")[name]
        if name == text:
            value = clean
        elif name == n_chars:
            counted = F.length(clean).cast(docs.schema[name].dataType)
            value = F.when(F.col("all_spans").isNull(), value).otherwise(counted)
        columns.append(value.alias(name))
    return joined.select(*columns)
