"""Secrets in texts: keys of known formats with their checks, and tokens that are random by a model of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialise

# Public formats of keys.
FORMATS = {
    "aws": r"A(?:KIA|SIA)[A-Z2-7]{16}",
    "github": r"gh[pousr]_[0-9A-Za-z]{36}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]+",
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "slack": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe": r"[rs]k_live_[0-9A-Za-z]{24,}",
}
#: What may be a secret without a format, and the words that the model of the corpus is fitted to.
TOKEN, WORD = r"[0-9A-Za-z+/_=-]{20,}", r"[0-9A-Za-z]+"
#: Letters of the longest of those words: shorter than a token, so that no secret teaches the model.
SHORT = 19
#: Letters and digits, without case.
SYMBOLS = 36
#: The logarithm of the odds of a random token against one of the corpus's kind that is asked for, and the share of the
#: largest possible entropy that its signs must have.
ODDS, SPREAD = 20.0, 0.7

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _checksum(token: Column) -> Column:
    """Whether the last six signs of a token write, in base 62, the CRC-32 of those between its first mark and them."""
    crc = F.crc32(F.substring(token, 5, 30).cast("binary"))
    digits = [F.substring(F.lit(_BASE62), (F.floor(crc / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)]
    return F.substring(token, 35, 6) == F.concat(*digits)


def _header(token: Column) -> Column:
    """Whether a token's first part is base64 of a JSON object that names an algorithm."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.get_json_object(F.try_validate_utf8(text), "$.alg").isNotNull()


CHECKS = {"github": _checksum, "jwt": _header}


def _bigrams(df: DataFrame, word: str) -> DataFrame:
    """df with a row for each pair of neighbouring signs of a word, without case; signs beyond letters and digits are one."""
    plain = df.withColumn("__plain", F.regexp_replace(F.lower(word), "[^0-9a-z]", "-"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("__plain") - 1), lambda i: F.substring(F.col("__plain"), i, 2))
    return plain.select(*df.columns, F.explode(pairs).alias("pair"))


def language(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """How often signs follow each other in the corpus's words: counts of pairs (pair, n), and of first signs (first, n).
    Each distinct word counts once, so neither a frequent word nor a text's copies weigh more; both tables have bounded
    sizes, SYMBOLS squared and SYMBOLS rows."""
    words = docs.select(F.explode(F.array_distinct(_matches(F.col(text_col), WORD))).alias("word")).filter(F.length("word").between(2, SHORT)).distinct()
    pairs = materialise(_bigrams(words, "word").groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    return pairs, pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("n"))


def random_tokens(tokens: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Those of the distinct tokens (value) that are random. A random token draws its signs evenly from its alphabet (hex,
    letters and digits, or those with marks); one of the corpus's kind follows the corpus's pairs (each pair counted once
    more than seen). The summed logarithms of the odds of its pairs must reach ODDS, its letters and digits both occur, and
    its signs be spread."""
    pairs, firsts = model
    odd = tokens.filter(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    hexa = F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    marks = F.col("value").rlike("[^0-9A-Za-z]")
    alphabet = F.when(hexa, 16).when(marks, SYMBOLS + 1).otherwise(SYMBOLS)
    signs = F.explode(F.split(F.lower("value"), "")).alias("sign")
    counts = odd.select("value", signs).groupBy("value", "sign").agg(F.count("*").alias("n"))
    spread = counts.groupBy("value").agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))
    seen = _bigrams(odd.select("value"), "value").withColumn("first", F.substring("pair", 1, 1))
    seen = seen.join(pairs.withColumnRenamed("n", "n_pair"), "pair", "left").join(firsts.withColumnRenamed("n", "n_first"), "first", "left")
    chance = (F.coalesce("n_pair", F.lit(0)) + 1) / (F.coalesce("n_first", F.lit(0)) + SYMBOLS + 1)
    told = seen.groupBy("value").agg(F.count("*").alias("pairs"), F.sum(F.ln(chance)).alias("log"))
    judged = odd.withColumn("alphabet", alphabet).join(told, "value").join(spread, "value")
    odds = -F.col("log") - F.col("pairs") * F.ln("alphabet")
    most = F.ln(F.least(F.col("alphabet"), F.length("value")))
    return judged.filter((odds >= ODDS) & (F.col("entropy") >= SPREAD * most)).select("value")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, value), a row for each secret found: a known format whose check holds, where it has one, or `random`,
    a token without a known format that random_tokens() finds. Null texts hold none; rows that repeat count again."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    def of(kind: str):
        return F.transform(_matches(F.col("text"), FORMATS[kind]), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = [of(kind) for kind in FORMATS]
    known = docs.select("doc_id", F.explode(F.concat(*kinds)).alias("x")).select("doc_id", "x.*")
    for kind, check in CHECKS.items():
        known = known.filter((F.col("kind") != kind) | check(F.col("value")))
    formats = "|".join(FORMATS.values())
    # what has a known format, whether its check holds or not, is no other token, and neither are its parts
    other = F.regexp_replace(F.col("text"), formats, " ")
    tokens = materialise(docs.select("doc_id", F.explode(_matches(other, TOKEN)).alias("value")), "tokens")
    found = random_tokens(tokens.select("value").distinct(), language(docs))
    return known.unionByName(tokens.join(found, "value").select("doc_id", F.lit("random").alias("kind"), "value"))


def redacted(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each secret of its text replaced by its kind in brackets, longer ones first."""
    own = found.select(F.col("doc_id").alias("__id"), "kind", "value").distinct()
    own = own.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("l"), "value", "kind"))).alias("__found"))
    text = F.aggregate("__found", F.col(text_col), lambda t, x: F.replace(t, x["value"], F.concat(F.lit("["), x["kind"], F.lit("]"))))
    return docs.join(own, F.col(id_col) == F.col("__id"), "left").withColumn(text_col, F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(text)).drop("__id", "__found")
