"""Personal data in texts by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail and IP addresses, card and phone numbers) are found by pattern and
checked. They are the seeds of a graph, with one in SEED_SHARE of the secrets of the most
explicit form: long mixed strings in quotes behind a key word (SECRETS), told off by a hash of
the string. All other identifier-like tokens (DIGITS digits, or a sign @) are instances without a
label, the other secrets of that form among them: those, and secrets in capitals, without quotes,
shorter or behind other words, are for the graph to find.
Every occurrence induces up to four lexical patterns:

l  the two words before it        k  the key before a sign = or :
s  the end of its shape           r  its shape and the word behind it

and each (pattern, instance) pair of the corpus is an edge. Spark scores both sides in turn for
ROUNDS rounds. Pattern: the weight of its seeds among all its distinct instances (with SMOOTHING
against small numbers), where tokens that have the form of a base entity and fail its check are
counterexamples that weigh as much as a seed, and instances without a label weigh UNKNOWN.
Instance: the evidence of all its patterns of FLOOR or more together,  1 - prod(1 - p).  One of
CONFIDENCE or more is promoted: in the next round it counts as a seed with its score, but never
for itself: towards a pattern it only has the evidence of its other patterns. In the end an
occurrence without a label whose own patterns give it CONFIDENCE becomes a span of kind
`context`. Neither secrets nor these touch a base span.

Matches of a kind are leftmost, non-overlapping, and dropped without a retry if the check
fails. The patterns below are the stated ones with possessive repeats and look-behinds where
these can't change a match, so that no text makes them backtrack. Places of matches are running
sums in two levels, so a text's cost follows its length and not the square of its matches.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans
(empty strings, and the digest of the empty string); rows are independent, but all rows'
seeds count for the patterns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone", "secret", "context"]
SECRET, CONTEXT = 4, 5
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KEY_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth"
VALUE = r"[A-Za-z0-9+/_.-]{32,}+={0,2}+"
SECRETS = rf"""(?<![A-Za-z0-9])(?:{KEY_WORDS})s?["']?\s{{0,3}}[=:]\s{{0,3}}["']{VALUE}(?=["'])"""
#: Distinct characters of a secret, at least.
SECRET_KINDS = 8
#: A text without a match of this has none of the kind.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"""[=:]\s{0,3}["'][A-Za-z0-9+/_.-]{32}"""}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Tokens of such a form that are no base entities failed a check.
FAILED = r"^(?:[0-9]+(?:\.[0-9]+){3}|\+[0-9][().0-9-]+[0-9]|[0-9](?:-?[0-9]){13,18})$"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What of a token stands before its identifier: a key with its sign, then marks.
LEAD = r"^(?:[^\s=:]*[A-Za-z][^\s=:]*[=:])?[^\p{L}\p{N}@+]*"
TRAIL = r"[^\p{L}\p{N}=]+$"
DIGITS = 4
#: Characters before and behind an identifier that its patterns may come from.
BEFORE, BEHIND = 48, 24
TWO_WORDS = r"\S+\s+\S+\s*$"
KEY = r"""([A-Za-z][A-Za-z0-9_-]*)["']?\s*[=:]\s*[^\p{L}\p{N}]*$"""
NEXT_WORD = r"^\S*\s+(\S+)"
#: Characters of a shape's end.
SHAPE_END = 14
#: One in so many secrets of the explicit form is a seed.
SEED_SHARE = 4
ROUNDS = 3
SMOOTHING = 1.0
#: What an instance without a label weighs against a pattern, and the least score of a pattern that counts.
UNKNOWN, FLOOR = 0.1, 0.5
CONFIDENCE = 0.75
#: Elements that one inner sum runs over.
CHUNK = 256
MATCH = "array<struct<start: int, kind: int, end: int, m: string, before: string, behind: string>>"
SPAN = "array<struct<start: int, kind: int, end: int>>"
ENTITY = "array<struct<start: int, kind: int, end: int, instance: string, patterns: array<string>>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each element of an array of int and all before it (0 before the first), in chunks, then over the chunks."""
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    step = lambda acc, x: F.array_append(acc, op(last(acc), x))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(xs, c * CHUNK + 1, CHUNK), none, step))
    carried = lambda parts: F.aggregate(parts, none, lambda acc, x: F.array_append(acc, op(last(acc), last(x))))
    whole = _let(
        F.struct(chunks.alias("parts")),
        lambda p: _let(
            F.struct(p["parts"].alias("parts"), carried(p["parts"]).alias("sums")),
            lambda q: F.flatten(F.transform(q["parts"], lambda part, i: F.transform(part, lambda x: op(F.coalesce(F.get(q["sums"], i - 1), F.lit(0)), x)))),
        ),
    )
    return F.when(F.size(xs) > 0, whole).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is a multiple of ten."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    fold = lambda acc, i: acc + F.when(digit(i) > 9, digit(i) - 9).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), fold) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of all matches: what lies between them gives their places and their surroundings."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p["ms"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m)), lambda a, b: a + b)
        return _let(F.struct(p["gaps"].alias("gaps"), p["ms"].alias("ms"), ends.alias("ends")), lambda q: F.transform(q["ms"], lambda m, i: one(q, m, i)))

    def one(q: Column, m: Column, i: Column) -> Column:
        end = F.get(q["ends"], i)
        before = F.right(F.concat(F.coalesce(F.get(q["ms"], i - 1), F.lit("")), F.get(q["gaps"], i)), F.lit(BEFORE))
        behind = F.left(F.concat(F.get(q["gaps"], i + 1), F.coalesce(F.get(q["ms"], i + 1), F.lit(""))), F.lit(BEHIND))
        return F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("m"), before.alias("before"), behind.alias("behind"))

    return _let(parts, placed)


def base_matches(text: Column) -> Column:
    """Array of the base entities, in order of start, then kind."""

    def of(kind: str) -> Column:
        ok = F.filter(_matches(text, BASE[kind], KINDS.index(kind)), lambda x: _valid(kind, x["m"]))
        return F.when(text.rlike(GUARD[kind]), ok).otherwise(F.array().cast(MATCH))

    return F.array_sort(F.concat(*map(of, BASE)))


def _inner(x: Column, value: Column, lead: Column) -> Column:
    """The match x cut to the part `value` of it that stands behind `lead` characters."""
    start = x["start"] + lead
    rest = F.concat(F.substring(x["m"], lead + F.length(value) + 1, F.length(x["m"])), x["behind"])
    before = F.right(F.concat(x["before"], F.substring(x["m"], F.lit(1), lead)), F.lit(BEFORE))
    return F.struct(start.alias("start"), x["kind"].alias("kind"), (start + F.length(value)).alias("end"), value.alias("m"), before.alias("before"), F.left(rest, F.lit(BEHIND)).alias("behind"))


def secret_matches(text: Column, share: int = SEED_SHARE) -> Column:
    """Array of the long mixed strings in quotes behind a key word, one in `share` of the different ones."""

    def value(x: Column) -> Column:
        v = F.regexp_extract(x["m"], f"{VALUE}$", 0)
        return _inner(x, v, F.length(x["m"]) - F.length(v))

    mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["m"], ""))) >= SECRET_KINDS) & (F.pmod(F.xxhash64(F.lower(x["m"])), F.lit(share)) == 0)
    found = F.filter(F.transform(_matches(text, SECRETS, SECRET), value), mixed)
    return F.when(text.rlike(GUARD["secret"]), found).otherwise(F.array().cast(MATCH))


def token_matches(text: Column) -> Column:
    """Array of the identifier-like tokens, without the marks around them."""

    def core(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], LEAD, 0))
        return _let(F.struct(x.alias("x"), lead.alias("lead")), lambda y: _inner(y["x"], F.regexp_replace(F.substring(y["x"]["m"], y["lead"] + 1, F.length(y["x"]["m"])), TRAIL, ""), y["lead"]))

    enough = lambda x: (F.length(_digits(x["m"])) >= DIGITS) | F.contains(x["m"], F.lit("@"))
    found = F.filter(F.transform(_matches(text, CANDIDATE, CONTEXT), core), enough)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(MATCH))


def _apart(spans: Column, others: Column) -> Column:
    """The spans (disjoint, in order) that touch none of the others (in order), in one pass over both."""
    edge = lambda x, i, mine: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["end"].alias("end"), i.alias("i"))
    both = F.array_sort(F.concat(F.transform(others, lambda x, i: edge(x, i, 0)), F.transform(spans, lambda x, i: edge(x, i, 1))))

    def kept(p: Column) -> Column:
        covered = _running(F.transform(p, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(0)), F.greatest)
        free = lambda q: F.filter(F.transform(q["p"], lambda x, j: F.struct(x.alias("x"), ((x["mine"] == 1) & (F.get(q["covered"], j) <= x["start"]) & F.coalesce(F.get(q["p"], j + 1)["start"] >= x["end"], F.lit(True))).alias("ok"))), lambda y: y["ok"])
        return _let(F.struct(p.alias("p"), covered.alias("covered")), lambda q: F.transform(free(q), lambda y: F.get(spans, y["x"]["i"])))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _let(both, kept)).otherwise(spans)


def _shape(m: Column) -> Column:
    low = F.lower(m)
    plain = F.right(F.regexp_replace(F.regexp_replace(low, r"\p{L}+", "a"), r"\p{N}", "0"), F.lit(SHAPE_END))
    mixed = low.rlike("[0-9][a-z]") & low.rlike("[a-z][0-9]")
    return F.when(mixed & low.rlike("^[0-9a-f]{16,}$"), "hex").when(mixed & low.rlike(r"^[a-z0-9+/_=.-]{16,}$"), "mix").otherwise(plain)


def entities(found: Column) -> Column:
    """Array of (start, kind, end, instance, patterns) of matches."""
    said = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{N}", "0"), r"\s+", " ")

    def made(x: Column) -> Column:
        left, key, right = F.trim(said(F.regexp_extract(x["before"], TWO_WORDS, 0))), F.lower(F.regexp_extract(x["before"], KEY, 1)), said(F.regexp_extract(x["behind"], NEXT_WORD, 1))
        shape = _shape(x["m"])
        some = F.array(F.when(left != "", F.concat(F.lit("l:"), left)), F.when(key != "", F.concat(F.lit("k:"), key)), F.concat(F.lit("s:"), shape), F.when(right != "", F.concat(F.lit("r:"), shape, F.lit(" "), right)))
        return F.struct(x["start"], x["kind"], x["end"], F.lower(x["m"]).alias("instance"), F.array_compact(some).alias("patterns"))

    return F.when(F.size(found) > 0, F.transform(found, made)).otherwise(F.array().cast(ENTITY))


def _evidence(doubt: Column) -> Column:
    """1 - prod(1 - p), of the sum of log(1 - p)."""
    return F.lit(1.0) - F.exp(doubt)


def scored_patterns(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, p, doubt) of those whose score p reaches FLOOR; doubt: log(1 - p).

    found: pattern, instance and kind of every occurrence. Edges are summed once; each round
    joins and sums them by instance, then by pattern. What is joined is written before, so a
    pattern or an instance with very many edges can be split, and sums start in each task.
    """
    label = F.when(F.col("kind") != CONTEXT, 1.0).when(F.col("instance").rlike(FAILED), 0.0)
    edges = materialise(found.groupBy("pattern", "instance").agg(F.max(label).alias("label")), "edges")
    pattern, score = None, F.lit(None).cast("double")
    for _ in range(rounds):
        if pattern is None:
            scored = edges.withColumn("score", score)
        else:
            open_ = edges.where("label IS NULL").join(pattern, "pattern")
            total = materialise(open_.groupBy("instance").agg(F.sum("doubt").alias("total")).where(_evidence(F.col("total")) >= confidence), "instances")
            other = _evidence(F.col("total") - F.coalesce("doubt", F.lit(0.0)))
            scored = edges.join(total, "instance", "left").join(pattern, "pattern", "left").withColumn("score", F.when(other >= confidence, other))
        value = F.coalesce("label", "score")
        weight = F.when(value.isNull(), UNKNOWN).otherwise(1.0)
        share = F.sum(F.coalesce(value, F.lit(0.0))) / (F.sum(weight) + F.lit(SMOOTHING))
        made = scored.groupBy("pattern").agg(F.round(share, 9).alias("p")).where(F.col("p") >= FLOOR)
        pattern = materialise(made.select("pattern", "p", F.log(1 - F.col("p")).alias("doubt")), "patterns")
    return pattern


def _listed(spans: Column) -> Column:
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SEED_SHARE) -> DataFrame:
    """(__tw_row, id, base, all) of every document: arrays of (start, kind, end)."""
    plain = lambda x: F.struct(x["start"], x["kind"], x["end"])
    few = docs.select(F.monotonically_increasing_id().alias("__tw_row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    few = few.withColumn("base", base_matches(F.col("t"))).withColumn("secret", secret_matches(F.col("t"), share)).withColumn("token", token_matches(F.col("t")))
    few = few.withColumn("seeds", F.array_sort(F.concat("base", _apart(F.col("secret"), F.col("base")))))
    few = few.withColumn("found", F.concat("seeds", _apart(F.col("token"), F.col("seeds"))))
    rows = materialise(few.select("__tw_row", "id", F.transform("base", plain).alias("base"), F.transform("seeds", plain).alias("seeds"), entities(F.col("found")).alias("found")), "pii")
    found = rows.select("__tw_row", F.explode("found").alias("e")).select("__tw_row", "e.*")
    found = found.select("__tw_row", "start", "kind", "end", "instance", F.explode("patterns").alias("pattern"))
    good = scored_patterns(found.select("pattern", "instance", "kind")).select("pattern", "doubt")
    new = found.where((F.col("kind") == CONTEXT) & ~F.col("instance").rlike(FAILED)).join(good, "pattern")
    new = new.groupBy("__tw_row", "start", "kind", "end").agg(F.sum("doubt").alias("doubt")).where(_evidence(F.col("doubt")) >= CONFIDENCE)
    new = new.groupBy("__tw_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    more = F.coalesce("new", F.array().cast(SPAN))
    return rows.join(new, "__tw_row", "left").select("__tw_row", "id", "base", F.array_sort(F.concat("seeds", more)).alias("all"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_context, n_spans) of every document."""
    out = find(docs, id_col, text_col)
    of = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    more = [*map(of, (SECRET, CONTEXT)), F.size("all").cast("bigint").alias("n_spans")]
    return out.select(F.col("id").alias(id_col), *map(of, range(SECRET)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), *more)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every document, spans replaced by their kind in brackets; of overlapping spans the first counts."""
    spans = F.col("__tw_spans")
    few = docs.select(id_col, F.col(text_col).alias("__tw_text"))
    # the patterns are learned over all documents, then found again in each text, so texts aren't shuffled twice
    rows = materialise(few.withColumn("__tw_row", F.monotonically_increasing_id()), "redact")
    found = find(rows.select("__tw_row", "__tw_text"), "__tw_row", "__tw_text").select(F.col("id").alias("__tw_row"), F.col("all").alias("__tw_spans"))
    text = F.col("__tw_text")

    # a span counts if it starts behind all spans before it; pieces are cut once and joined once
    ends = lambda s: _running(F.transform(s, lambda x: x["end"]), F.greatest)
    before = lambda q, i: F.coalesce(F.get(q["ends"], i - 1), F.lit(0))
    name = lambda x: F.get(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["kind"])
    piece = lambda q: lambda x, i: F.when(x["start"] < before(q, i), F.lit("")).otherwise(F.concat(F.substring(text, before(q, i) + 1, x["start"] - before(q, i)), name(x)))
    clean = _let(F.struct(spans.alias("s"), ends(spans).alias("ends")), lambda q: F.concat(F.array_join(F.transform(q["s"], piece(q)), ""), F.substring(text, before(q, F.size(q["s"])) + 1, F.length(text))))
    return rows.join(found, "__tw_row").select(id_col, F.when(text.isNotNull(), clean).alias(text_col))
