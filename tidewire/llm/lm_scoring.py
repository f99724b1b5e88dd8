"""Stupid-backoff scores of documents, by joins of n-gram count tables.

v(ngram) is  log10(C(ngram) / C(ngram without its last word))  if the n-gram is in the model,
else  log10(ALPHA) + v(ngram without its first word);  v(word) is  log10(C(word) / N).  C counts
over all documents, the scored one included, N is all tokens. An n-gram of two words or more is
in the model if it occurs MIN_COUNT times, as rare ones tell of nothing but their own text. A
document starts with ORDER - 1 marks and ends with another; the end is a token. Its score is
the mean v of the ORDER-grams that end at its tokens.

All of it is relational. With  delta = v(ngram) - log10(ALPHA) - v(ngram without first word)  for
the n-grams in the model (and v itself for words), the sum of v over a document is the sum of
delta over its n-grams of all orders, plus log10(ALPHA) for each token and order above one:

1. Count tables: texts are exploded to n-grams, counted in each task, then by hash. An n-gram
   is the pair (prefix, suffix) of the keys of its shorter ones, 64-bit hashes each.
2. Terms (key, delta): the count table of an order, joined by prefix and by suffix to the terms
   of the order below.
3. Sums: exploded n-grams of all orders joined by key to the terms and summed per document. The
   HOT most frequent terms at most are broadcast, so frequent keys are never shuffled, and a
   task's documents sum up there; the other n-grams meet their terms by hash.

Every table is written to the shared folder before the next step, whose shuffle files go when it
is done, so the disk holds one step at a time. Nothing that grows comes to the driver.

Words: the text in lower case, cut at runs of `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.

Defined results: a null or empty text has one token, its end; rows that share an id, or have
none, are documents each and count each; columns other than the id and the text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, identified, materialise

ALPHA = 0.4
ALPHA_LOG = math.log10(ALPHA)
ORDER = 2
MIN_COUNT = 2
#: Most terms that are broadcast (a key and a number each).
HOT = 200_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks hold a space, so no word equals them.
BEGIN, END = " begin", " end"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _key(words: list[Column]) -> Column:
    """The key of an n-gram: the hash of a word, or of the keys of prefix and suffix."""
    return F.xxhash64(words[0]) if len(words) == 1 else F.xxhash64(_key(words[:-1]), _key(words[1:]))


def windows(docs: DataFrame, size: int, order: int) -> DataFrame:
    """(doc, w1 .. w_size): the words of every window of marked texts. docs: doc, text."""
    marked = docs.select("doc", F.concat(F.array(*[F.lit(BEGIN)] * (order - 1)), _words(F.col("text")), F.array(F.lit(END))).alias("t"))
    n = F.size("t") - size + 1
    zipped = F.arrays_zip(*(F.slice("t", i + 1, n).alias(f"w{i + 1}") for i in range(size)))
    return marked.select("doc", F.explode(zipped).alias("x")).select("doc", *(F.col(f"x.w{i + 1}").alias(f"w{i + 1}") for i in range(size)))


def _columns(a: int, b: int) -> list[Column]:
    return [F.col(f"w{i}") for i in range(a, b + 1)]


def terms(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """(k, n, delta, top) of the words and of the n-grams in the model; top: those of the highest order."""
    many = F.count(F.lit(1)).alias("n")
    marked = windows(docs, 1, order)
    counts = materialise(marked.groupBy(_key(_columns(1, 1)).alias("k"), (F.col("w1") == BEGIN).alias("mark")).agg(many), "words")
    total = float(counts.where("NOT mark").agg(F.sum("n")).first()[0] or 1)
    made = counts.select("k", "n", F.log10(F.col("n") / F.lit(total)).alias("v"))
    out, parts = [made.withColumn("delta", F.col("v"))], [counts]
    for size in range(2, order + 1):
        pairs = windows(docs, size, order).select(_key(_columns(1, size - 1)).alias("p"), _key(_columns(2, size)).alias("s"))
        counted = materialise(pairs.groupBy("p", "s").agg(many).where(F.col("n") >= min_count), f"grams-{size}")
        below = made.select(F.col("k").alias("p"), F.col("n").alias("context"))
        shorter = made.select(F.col("k").alias("s"), F.col("v").alias("short"))
        with_context = materialise(counted.join(below, "p"), "contexts")
        discard(counted)
        v = F.log10(F.col("n") / F.col("context"))
        made = with_context.join(shorter, "s").select(F.xxhash64("p", "s").alias("k"), "n", v.alias("v"), (v - F.lit(ALPHA_LOG) - F.col("short")).alias("delta"))
        made = materialise(made, f"terms-{size}")
        discard(with_context)
        parts.append(made)
        out.append(made)
    whole = reduce(DataFrame.union, (t.select("k", "n", "delta", F.lit(int(i == order - 1)).alias("top")) for i, t in enumerate(out)))
    whole = materialise(whole, "terms")
    discard(*parts)
    return whole


def _least_hot(all_terms: DataFrame, hot: int) -> int:
    """The least power of two that at most `hot` terms reach."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(all_terms.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect())  # a row a power of two
    return next(1 << at for at in range(65) if sum(c for x, c in sizes.items() if x >= at) <= hot)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, hot: int = HOT) -> DataFrame:
    """(id, n_tokens, n_backoff, score) of every document; n_backoff: tokens whose longest n-gram isn't in the model."""
    rows = identified(docs, id_col, text_col)
    found = terms(rows, order, min_count)
    least = _least_hot(found, hot)
    warm = F.broadcast(found.where(F.col("n") >= least).select("k", "delta", "top"))
    grams = windows(rows, order, order).select("doc", F.explode(F.array(*(_key(_columns(order - i, order)) for i in range(order)))).alias("k"))
    sums = [F.sum("delta").alias("bits"), F.sum("top").cast("bigint").alias("known")]
    near = grams.join(warm, "k").groupBy("doc").agg(*sums)
    cold = grams.join(warm.select("k"), "k", "left_anti").join(found.where(F.col("n") < least).select("k", "delta", "top"), "k")
    near, cold = materialise(near, "hot-sums"), materialise(cold.groupBy("doc").agg(*sums), "cold-sums")
    total = near.union(cold).groupBy("doc").agg(F.sum("bits").alias("bits"), F.sum("known").alias("known"))
    tokens = rows.select("doc", F.col("id").alias(id_col), (F.size(_words(F.col("text"))) + 1).cast("bigint").alias("n_tokens"))
    score = F.round(F.col("bits") / F.col("n_tokens") + F.lit((order - 1) * ALPHA_LOG), 6)
    return tokens.join(total, "doc").select(id_col, "n_tokens", (F.col("n_tokens") - F.col("known")).alias("n_backoff"), score.alias("score"))
