"""Secrets: three fixed patterns, and character Markov models for everything that looks random.

Two models of neighbouring characters, one of secrets and one of ordinary words and identifiers,
are counted from labelled samples; a long token is a secret where its log-likelihood ratio is high
enough, in total and for each character. DataFrame functions only. Spans are code points, the end
exclusive, and a pattern's span is its whole match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
#: What the models judge: runs of at least 12 of their characters.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bounds of the labelled samples, in documents; thresholds of the ratio in nats.
ORDINARY_TEXTS, SECRET_TEXTS = 2_000, 5_000
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.3
#: Occurrences that the frequency of a character alone counts for, beside those of a pair.
BACK_OFF = 5.0
#: Occurrences of a character from which on its successors are rather guessed from all text than as any.
RARE = 50.0
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,m:string>>"


def located(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All matches in order, with their places: the lengths of what lies between them add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, between, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def within(xs):
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)

    def placed(xs):
        """Blocks of about the root of all matches, so that no fold grows a long array."""
        block = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), block), lambda i: within(F.slice(xs, i, block)))
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["at"]))
        moved = F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), lambda x, by: F.transform(
            x["out"], lambda y: F.struct((y["start"] + by).alias("start"), y["ord"].alias("ord"), (y["end"] + by).alias("end"), y["kind"].alias("kind"), y["m"].alias("m"))))
        return F.flatten(moved)

    # a name for the matches, which are then looked for once
    spans = F.element_at(F.transform(F.array(pairs), placed), 1)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    assign = F.filter(located(text, ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8)
    return F.concat(assign, located(text, ACCESS, "access", 1), located(text, HEX, "hex", 2))


def _bigrams(tokens: DataFrame, label: int) -> DataFrame:
    """(pair of alphabet places, label, n) from a column ``w``. Ordinary pairs of a single text do not
    count: they may be of a secret that no pattern knows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))
    counted = tokens.filter(F.length("w") >= 2).select("doc_id", F.explode(pairs).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"), (F.min("doc_id") < F.max("doc_id")).alias("spread"))
    counted = counted if label else counted.filter("spread")
    return counted.select(F.expr(f"instr('{ALPHABET}', substring(p, 1, 1))").alias("i"), F.expr(f"instr('{ALPHABET}', substring(p, 2, 1))").alias("j"), F.lit(label).alias("label"), "n").filter("i > 0 AND j > 0")


def train(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """Log ratios P(next | character) of secrets to ordinary text, row after row of the alphabet.

    The samples label themselves: values of the three patterns, and the words of texts without
    them. None if there is no secret to learn from.
    """
    texts = docs.select("doc_id", text_or_empty(text_col).alias("text"))

    def first(df: DataFrame, n: int) -> DataFrame:
        """The texts of the n smallest hashes of ids; only ids are sorted, and n of them are broadcast."""
        ids = df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        return df.join(F.broadcast(ids), "doc_id", "left_semi")

    hit = F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    value = F.transform(base_spans(F.col("text")), lambda x: F.when(x["kind"] == "assign", F.regexp_extract(x["m"], ASSIGN, 1)).otherwise(x["m"]))
    secret = first(texts.filter(hit), SECRET_TEXTS).select("doc_id", F.explode(value).alias("w"))
    plain = first(texts.filter(~hit), ORDINARY_TEXTS).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("w"))
    counts = _bigrams(secret, 1).unionByName(_bigrams(plain, 0)).collect()  # at most 2 x alphabet^2 rows
    size = len(ALPHABET)
    n = [[0.0] * (size * size) for _ in range(2)]
    for r in counts:
        n[1 if r["label"] else 0][(r["i"] - 1) * size + r["j"] - 1] += r["n"]
    if not sum(n[1]):
        return None

    def logs(k: list[float]) -> list[float]:
        """log P(next | character), leaning on how frequent the next is anywhere, and on nothing known
        where the character itself is rare."""
        after = [sum(k[i * size : (i + 1) * size]) for i in range(size)]
        each = [(sum(k[j::size]) + 0.5) / (sum(k) + 0.5 * size) for j in range(size)]
        known = [a / (a + RARE) for a in after]
        lean = lambda i, j: known[i] * each[j] + (1 - known[i]) / size
        return [math.log((k[i * size + j] + BACK_OFF * lean(i, j)) / (after[i] + BACK_OFF)) for i in range(size) for j in range(size)]

    return [a - b for a, b in zip(logs(n[1]), logs(n[0]), strict=True)]


def markov_spans(text: Column, ratios: list[float] | None) -> Column:
    """The tokens that the secrets' model explains better."""
    if ratios is None:
        return F.array().cast(SPAN)
    weights = F.from_json(F.lit(str([round(x, 4) for x in ratios])), "array<double>")

    def ratio(token):
        places = F.transform(F.split(token, ""), lambda ch: F.call_function("instr", F.lit(ALPHABET), ch))
        steps = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda i, j: (i - 1) * len(ALPHABET) + j)
        return F.aggregate(steps, F.lit(0.0), lambda acc, at: acc + F.element_at(weights, at.cast("int")))

    return F.filter(located(text, TOKEN, "markov", 3), lambda x: ratio(x["m"]) >= F.greatest(F.lit(LEAST_TOTAL), F.lit(LEAST_MEAN) * (x["end"] - x["start"] - 1)))


def secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (both sorted by start, then kind) for every row of ``docs``.

    The models' spans that overlap one of a pattern are left out. Null and empty texts have no
    spans; repeated rows and null ids are scanned like any others.
    """
    ratios = train(docs, text_col)
    rows = docs.select("doc_id", text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", F.sort_array(base_spans(F.col("text"))).alias("base"), markov_spans(F.col("text"), ratios).alias("more"))
    apart = F.filter("more", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", apart)).alias("spans"))


def written(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def query(spark, sf_dir):
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
