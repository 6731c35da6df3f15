"""PII (operator 9): patterns with checks, and information-theoretic sanitisation. DataFrame functions only.

Base kinds, leftmost and without overlap within a kind; a match that fails its check is dropped:
email; ip (parts at most 255); card (16 to 19 digits, Luhn); phone (8 to 15 digits). The patterns below match what the
plain ones in PLAIN match, but never step back over what they took and start a run only where it starts, so long runs of
digits or letters take linear time and no deep stack.

Terms. Protected entities are values (a kind with its value) and parts of values: an address's domain, the first two
numbers of an ip, a card's first six digits, a phone's first four. Over N distinct texts (copies count once), n(e) texts
with entity e, n(t) with term t (a word of MIN_LETTERS letters or more, outside addresses) and n(e, t) with both give

    PMI(e; t) = log2(N * n(e, t) / (n(e) * n(t)))   against   IC(e) = log2(N / n(e)).

PMI / IC is the share of e's information that t discloses: 1, if t never occurs without e.

- Entities in `support` texts or more: t discloses e if n(e, t) is `support` or more, the share is `threshold` or more,
  and by Chernoff's bound chance gives so many common texts with CHANCE or less.
- Entities in fewer texts give no such estimate, and all rare words of their texts would seem to disclose them. There t
  discloses e if it stands within WINDOW characters of e, or in e's own value, in each of e's texts, and occurs in no other
  text of the corpus (a share of 1): as a name beside an address that both stand nowhere else.

A disclosing term is a span of kind `term` wherever it stands in a text with its entity, unless it overlaps a base span.
sanitise() generalises base values to their kind; it removes terms that disclose a value, and generalises those that
disclose only a part to the kind of that part.

Entities, terms and their common texts are counted by aggregates that begin in every partition, so frequent ones are no
hot groups; texts travel only if they hold a base span, once for each distinct text. Null texts count as empty and get
zero counts and empty span lists; equal texts get equal spans, repeated rows are returned each; offsets are code points,
ends exclusive. An empty table gives no rows. Spans are put together in blocks, so a text with very many of them takes
time in proportion, not squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns as they are specified.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
}
#: What a text must hold for a kind to be looked for.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"(?<![\p{L}\p{N}])\p{L}{%d,}+(?![\p{L}\p{N}])"
WINDOW, MIN_LETTERS = 80, 3
SUPPORT, THRESHOLD, CHANCE = 3, 0.7, 1e-4
#: Bytes of a table that is sent to all executors at most; larger ones are joined by shuffle.
BROADCAST_BYTES = 8_000_000
#: Spans that are put together at once.
_BLOCK = 128
_SPAN = "struct<start:long,end:long,value:string>"
_ADDRESS = _FAST["email"]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _blocks(xs: Column) -> Column:
    """The array in blocks; of an empty one an empty block."""
    last = lambda v: F.greatest(F.lit(0), F.ceil(F.size(v) / _BLOCK).cast("int") - 1)
    return _let(xs, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK))))


def _before(xs: Column, f: Callable[[Column], Column]) -> Column:
    """For each element f of those before it; few elements."""
    return F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda k: f(F.slice(xs, F.lit(1), k)))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches: what stands between matches gives their places."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    sized = F.transform(both, lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.coalesce(F.char_length(x["value"]), F.lit(0)).cast("long").alias("size"), x["value"].alias("value")))
    none, zero = F.array().cast(f"array<{_SPAN}>"), F.lit(0).cast("long")

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + x["gap"]
        end = begin + x["size"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        # the last gap has no match after it
        return F.when(x["value"].isNull(), seen).otherwise(F.struct(end.alias("at"), F.concat(seen["out"], one).alias("out")))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda n, x: n + x["gap"] + x["size"]))
        starts = _let(sums, lambda n: _before(n, lambda some: F.aggregate(some, zero, lambda a, x: a + x)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda seen: seen["out"])))

    return _let(sized, lambda xs: _let(_blocks(xs), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits, of at most a few dozen, passes."""
    n = F.length(digits)

    def step(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = _HINT[kind]
    there = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    return F.when(there, F.filter(spans_of(text, _FAST[kind]), lambda x: _valid(kind, x["value"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _all_base(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the base kinds, in the order of KINDS, then start."""

    def named(kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return F.concat(*(named(k) for k in KINDS))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (64-bit hash of the text), spans (kind, start, end, value) and text of every row; no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), _all_base(F.col("text")).alias("spans"), "text")


# --- entities and terms ---


def _value_of(s: Column) -> Column:
    """The entity of a span's value."""
    digits = _digits(s["value"])
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(digits))


def _part_of(s: Column) -> Column:
    """The entity of a span's part."""
    digits = _digits(s["value"])
    part = F.when(s["kind"] == "email", F.lower(F.substring_index(s["value"], "@", -1))).when(s["kind"] == "ip", F.substring_index(s["value"], ".", 2))
    return F.concat(s["kind"], F.lit("~"), part.when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4)))


def _words(text: Column) -> Column:
    """The words of a text, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD % MIN_LETTERS), F.lit(0))


def _vocabulary(text: Column) -> Column:
    """The distinct words of a text outside addresses."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _ADDRESS, "0")).otherwise(text)
    return F.array_distinct(_words(rest))


def _contexts(text: Column, spans: Column) -> Column:
    """array<struct<value, part, words>>: of each span its entities and the words in it and near it, without those that
    the border of the window may cut."""

    def region(some: Column) -> Column:
        begin = F.greatest(F.lit(0).cast("long"), F.array_min(F.transform(some, lambda s: s["start"])) - WINDOW)
        end = F.array_max(F.transform(some, lambda s: s["end"])) + WINDOW
        return F.struct(some.alias("spans"), begin.alias("at"), F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))

    def one(x: Column, s: Column) -> Column:
        begin = F.greatest(F.lit(0).cast("long"), s["start"] - WINDOW)
        left = F.substring(x["text"], (begin - x["at"] + 1).cast("int"), (s["start"] - begin).cast("int"))
        right = F.substring(x["text"], (s["end"] - x["at"] + 1).cast("int"), F.lit(WINDOW))
        left = F.when(begin > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
        right = F.when(F.char_length(right) == WINDOW, F.regexp_replace(right, r"[\p{L}\p{N}]++$", "")).otherwise(right)
        return F.struct(_value_of(s).alias("value"), _part_of(s).alias("part"), _words(F.concat_ws("\n", left, s["value"], right)).alias("words"))

    near = F.transform(F.filter(_blocks(F.array_sort(F.transform(spans, _placed))), lambda b: F.size(b) > 0), region)
    return F.flatten(F.transform(near, lambda x: F.transform(x["spans"], lambda s: one(x, s))))


def _placed(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))


def _bounded(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """df, to be sent to all executors if its rows, of about so many bytes, are known to be few."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def _disclosing(texts: DataFrame, each: DataFrame, docs: DataFrame, text: Column, support: int, threshold: float) -> DataFrame:
    """(entity, term): the terms that disclose an entity, from texts (text_key, text, spans), each (text_key, entity, n_e)."""
    key = F.xxhash64(text).alias("text_key")
    total = docs.select(key).distinct().count()
    ratio = lambda n_et, n_t: F.log2(total * n_et / (F.col("n_e") * n_t)) / F.log2(total / F.col("n_e"))

    # frequent entities: their whole texts are the contexts
    often = each.filter((F.col("n_e") >= support) & (F.col("n_e") < total))
    held = texts.join(often.select("text_key").distinct(), "text_key", "left_semi")
    once = materialise(held.select("text_key", F.explode(_vocabulary(F.col("text"))).alias("term")), "words")
    pairs = once.join(often, "text_key").groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    # a term in more texts than `most` can't reach the threshold; some of its texts are known already
    least = once.groupBy("term").agg(F.count("*").alias("least"))
    most = F.col("n_et") * F.pow(total / F.col("n_e"), F.lit(1 - threshold))
    pairs = pairs.join(least, "term").filter(F.col("least") <= most + 1e-6).select("entity", "n_e", "term", "n_et")

    # rare entities: what is near them in all their texts, and nowhere else
    seldom = each.filter(F.col("n_e") < support)
    near = texts.select("text_key", F.explode(_contexts(F.col("text"), F.col("spans"))).alias("c"))
    near = near.select("text_key", F.explode(F.array("c.value", "c.part")).alias("entity"), "c.words")
    near = near.join(seldom, ["text_key", "entity"]).select("text_key", "entity", "n_e", F.explode(F.array_distinct("words")).alias("term")).distinct()
    near = near.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et"), F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("n_et = n_e")
    near = materialise(near.withColumn("h", F.xxhash64("term")), "near")
    pairs = materialise(pairs, "pairs")
    words = docs.select(key, F.explode(_vocabulary(text)).alias("term"))
    if not near.isEmpty():
        # in how many texts a term stands is more than is asked here: of a term of one text, or two, these are the
        # first and the last, which needs no row for each text of each word
        ends = words.groupBy(F.xxhash64("term").alias("h")).agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
        near = materialise(near.join(ends, ["h", "low", "high"], "left_semi").select("entity", "n_e", "term", "n_et"), "near")
    else:
        near = near.select("entity", "n_e", "term", "n_et")
    asked = pairs.unionAll(near.filter("n_e > 1"))
    n = asked.count()
    told = near.filter("n_e = 1").select("entity", "term")
    if n:
        terms = asked.select("term").distinct()
        n_t = words.join(_bounded(terms, n), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
        a, b, p = F.col("n_et"), F.col("n_t"), F.col("n_e") / total
        chance = a * F.log(a / b / p) + F.when(b > a, (b - a) * F.log((1 - a / b) / (1 - p))).otherwise(0.0)
        told = told.unionAll(pairs.join(n_t, "term").filter((ratio(a, b) >= threshold) & (chance >= -F.log(F.lit(CHANCE)))).select("entity", "term"))
        told = told.unionAll(near.filter("n_e > 1").join(n_t, "term").filter("n_t = n_e").select("entity", "term"))
    return materialise(told, "disclosing")


_TERMS = "array<struct<kind:string,start:long,end:long,value:string,general:string>>"


def terms(found: DataFrame, docs: DataFrame, *, text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """For each text that has some: text_key and terms (kind, start, end, value, general), the disclosing terms by start, and
    how many there are. general: null, or the kind that the term is generalised to.

    found: detect()'s rows, of which those without a base span may lack their text; docs: the corpus."""
    held = found.filter(F.size("spans") > 0).select("text_key", "spans", "text")
    texts = materialise(held.dropDuplicates(["text_key"]), "texts")
    entities = F.array_distinct(F.concat(F.transform("spans", _value_of), F.transform("spans", _part_of)))
    each = materialise(texts.select("text_key", F.explode(entities).alias("entity")), "entities")
    each = each.join(each.groupBy("entity").agg(F.count("*").alias("n_e")), "entity")
    told = _disclosing(texts, each, docs, F.coalesce(F.col(text_col), F.lit("")), support, threshold)
    n = told.count()
    # entities of values are written with a colon, those of parts with a tilde, which no value holds
    general = F.when(F.max(F.contains("entity", F.lit(":"))), None).otherwise(F.upper(F.substring_index(F.min("entity"), "~", 1)))
    marked = materialise(each.join(_bounded(told, n), "entity").groupBy("text_key", "term").agg(general.alias("general")), "told")
    n = marked.count()
    some = texts.join(_bounded(marked.select("text_key").distinct(), n), "text_key", "left_semi")
    parts = F.arrays_zip(F.split("text", _WORD % MIN_LETTERS, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_WORD % MIN_LETTERS), F.lit(0)).alias("value"))
    parts = some.select("text_key", F.posexplode(parts).alias("place", "x")).filter("x.value is not null")
    end = F.sum(F.char_length("x.gap") + F.char_length("x.value")).over(Window.partitionBy("text_key").orderBy("place")).cast("long")
    at = parts.select("text_key", (end - F.char_length("x.value")).alias("start"), end.alias("end"), F.lower("x.value").alias("value"))
    at = at.join(_bounded(marked.withColumnRenamed("term", "value"), n), ["text_key", "value"])
    # base spans from both sides: one that began before may reach into a term, or one may begin in it
    base = some.select("text_key", F.explode("spans").alias("s")).select("text_key", "s.start", "s.end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("general"))
    both = at.select("text_key", "start", "end", "value", "general").unionAll(base)
    is_base = F.col("value").isNull()
    before = Window.partitionBy("text_key").orderBy("start", F.desc("end"), F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("text_key").orderBy(F.desc("start"), "end", F.desc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
    free = both.filter(~is_base & (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "value", "general")))
    rows = F.transform(rows, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), t["general"].alias("general")))
    return materialise(free.groupBy("text_key").agg(rows.alias("terms"), F.count("*").alias("n")), "terms")


def _sent(told: DataFrame) -> DataFrame:
    """terms()'s result without numbers, to be sent to all executors if it is small: by the spans in it, not its rows."""
    return _bounded(told.drop("n"), told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"], 128)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans (base) and terms of every row: array<struct<kind, start, end, value>>, terms with general as well."""
    found = detect(docs, id_col=id_col, text_col=text_col)
    held = materialise(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")
    told = terms(held, docs, text_col=text_col, support=support, threshold=threshold)
    return held.drop("text").join(_sent(told), "text_key", "left").select("doc_id", "spans", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, tag), sorted, replaced by its tag; of one that begins in an earlier span only
    what stands beyond that goes, without a tag."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")

    def ends(b: Column) -> Column:
        return F.array_max(F.transform(b, lambda s: s["end"]))

    def step(x: Column):
        def one(seen: Column, s: Column) -> Column:
            gap = F.substring(x["text"], (seen["at"] - x["at"] + 1).cast("int"), F.greatest(zero, s["start"] - seen["at"]).cast("int"))
            tag = F.when(s["start"] < seen["at"], F.lit("")).otherwise(s["tag"])
            return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), F.concat(seen["out"], F.array(gap, tag)).alias("out"))

        return one

    def region(b: Column, at: Column) -> Column:
        return F.struct(b.alias("spans"), at.alias("at"), F.substring(text, (at + 1).cast("int"), (F.greatest(at, ends(b)) - at).cast("int")).alias("text"))

    def whole(blocks: Column) -> Column:
        starts = _let(F.transform(blocks, ends), lambda n: _before(n, lambda some: F.greatest(zero, F.array_max(some))))
        regions = F.zip_with(blocks, starts, region)
        parts = F.flatten(F.transform(regions, lambda x: F.aggregate(x["spans"], F.struct(x["at"].alias("at"), none.alias("out")), step(x), lambda seen: seen["out"])))
        rest = F.substring(text, (F.array_max(F.transform(blocks, ends)) + 1).cast("int"), F.lit((1 << 31) - 1))
        return F.array_join(F.concat(parts, F.array(rest)), "")

    return _let(_blocks(spans), whole)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the text column sanitised: base spans become [EMAIL], [IP], [CARD], [PHONE]; terms that disclose a value
    are removed, those that disclose only a part become [EMAIL TERM] and so on. All rows and columns stay; null texts stay
    null. Texts stay where they are unless the term table is too large to be sent."""
    found = detect(docs, id_col=id_col, text_col=text_col).filter(F.size("spans") > 0)
    told = terms(found, docs, text_col=text_col, support=support, threshold=threshold)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("__pii_spans", _all_base(text)).withColumn("__pii_key", F.xxhash64(text))
    found = found.join(_sent(told).toDF("__pii_key", "__pii_terms"), "__pii_key", "left")
    tag = lambda *x: F.concat(F.lit("["), *x, F.lit("]"))
    base = F.transform("__pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(F.upper(s["kind"])).alias("tag")))
    more = F.transform(F.coalesce("__pii_terms", F.array().cast(_TERMS)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["general"].isNull(), "").otherwise(tag(s["general"], F.lit(" TERM"))).alias("tag")))
    clean = F.when(F.size("__pii_spans") > 0, _replaced(text, F.array_sort(F.concat(base, more)))).otherwise(F.col(text_col))
    return found.withColumn("__pii_clean", clean).select(*(F.col("__pii_clean").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """From find(): doc_id, counts by kind, base_sha256, spans as text, n_term."""
    of = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.array_join(F.filter(F.array(_joined(F.col("spans")), _joined(F.col("terms"))), lambda x: x != ""), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), both.alias("spans"), F.size("terms").cast("long").alias("n_term"))
