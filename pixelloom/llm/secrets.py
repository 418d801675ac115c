"""Secret scans with character Markov models, in DataFrame functions only.

Three patterns give the base spans. Beyond them, long tokens are compared under
two first-order Markov models of their characters, one of random strings and one
of ordinary identifiers: a token is a secret of kind `random` if its mean
log-likelihood ratio is high enough. So that ordinary words joined to a key don't
average it away, the same holds for each part of 16 characters or more between
/ _ -, and for each stretch of parts of 24 characters or more (a short word that
the models don't know weighs less in those). The span is the whole token. Equal
neighbouring characters say nothing for a secret (they are rulers and fillings),
and a token without a letter is a number and no secret.

The models are trained from labelled samples: random strings over the usual
alphabets of keys, and ordinary identifiers made of all words of a sample of about
`sample` documents, drawn by how often they occur (a parameter; scanning covers all
documents and whole texts).

Defined cases: a null text is an empty text and has no spans; a text or token of
any length is scanned whole; rows that repeat are scanned each on its own; an
empty table gives an empty result and the models then know no words; only doc_id
and text are read. Offsets count code points.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
PART = "[A-Za-z0-9+]{16,}"
#: Least characters of a stretch of parts, and what joins the parts.
STRETCH, JOINTS = 24, "/_-"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SPAN = "array<struct<start:int,kind:int,stop:int>>"


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of each pair of neighbouring characters (row-major over ALPHABET), and the least mean ratio of a secret's stretch."""

    ratio: tuple[float, ...]
    least: float = 0.35


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Samples labelled random: strings over the alphabets in which keys and tokens are written."""
    rng = random.Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    alphabets = [letters + digits, letters[26:] + digits, letters[:26] + digits, ALPHABET[:64], letters + digits + "_-", "0123456789abcdef"]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))) for _ in range(n)]


def ordinary_identifiers(words: list[str], n: int, seed: int = 12, counts: list[int] | None = None) -> list[str]:
    """Samples labelled ordinary: words, drawn by their counts, as they are joined in identifiers, paths and file names, with numbers now and then."""
    rng = random.Random(seed)
    if not words:
        return []
    out, upto = [], list(accumulate(counts or [1] * len(words)))
    for _ in range(n):
        parts = rng.choices(words, cum_weights=upto, k=rng.randint(1, 5))
        style = rng.randrange(6)
        if style == 1:
            parts = [p.upper() for p in parts]
        elif style == 2:
            parts = [p.capitalize() for p in parts]
        if rng.random() < 0.3:
            parts.append(str(rng.choice([rng.randint(0, 99), rng.randint(1900, 2099), rng.randint(0, 10**8)])))
        out.append(rng.choice(["", "_", "-", "/"] if style != 2 else [""]).join(parts))
    return out


def train(samples: DataFrame, smoothing: float = 0.5) -> Models:
    """Models of samples (text, label: 1 random, 0 ordinary)."""
    pairs = (
        samples.select("label", F.split("text", "").alias("c"))
        .where("size(c) > 1")
        .select("label", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
        .select("label", "p.a", "p.b")
        .groupBy("label", "a", "b")
        .count()
    )
    size = len(ALPHABET)
    counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
    for r in pairs.collect():  # two models of at most len(ALPHABET) ** 2 pairs
        if (i := ALPHABET.find(r.a)) >= 0 and (j := ALPHABET.find(r.b)) >= 0 and r.a and r.b:
            counts[r.label][i][j] += r["count"]
    log = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
    return Models(tuple(log[1][i][j] - log[0][i][j] for i in range(size) for j in range(size)))


def fit(docs: DataFrame, sample: int = 2000, strings: int = 20_000) -> Models:
    """train() on random strings and on identifiers of the words of about `sample` of the documents."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))
    words = part.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,12}(?![A-Za-z0-9])"), 0)).alias("w"))
    # all words of the sample, whose size is bounded
    found = sorted((r["w"], r["count"]) for r in words.groupBy("w").count().collect())
    ordinary = ordinary_identifiers([w for w, _ in found], strings, counts=[n for _, n in found])
    rows = [(t, 1) for t in random_strings(strings)] + [(t, 0) for t in ordinary]
    return train(docs.sparkSession.createDataFrame(rows, "text string, label int"))


def _bound(value: Column, then) -> Column:
    """then(value), where value is computed once however often then() names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _blocks(values: Column) -> Column:
    """A non-empty array as about as many arrays as each of them has entries."""
    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    return _bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / w).cast("int")), lambda b: F.slice(values, b * w + 1, w)))


def _located(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, stop, kind, value) of the pattern's matches; value is the group.

    split() gives what lies between the matches, so lengths add up to offsets: a match starts a gap after the one before
    it. The sums run within blocks of matches, and over the blocks, so the work is the number of matches to the power 1.5.
    """
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>)")
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = _bound(sizes, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("g"), F.regexp_extract_all(text, F.lit(pattern), group).alias("v")))

    def add(done: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0)) + x["g"]
        return F.concat(done, F.array(F.named_struct(F.lit("start"), start, F.lit("kind"), F.lit(kind), F.lit("stop"), start + x["m"], F.lit("value"), x["v"])))

    def shifted(part: Column) -> Column:
        return F.transform(part["rows"], lambda s: F.named_struct(F.lit("start"), s["start"] + part["first"], F.lit("kind"), s["kind"], F.lit("stop"), s["stop"] + part["first"], F.lit("value"), s["value"]))

    def joined(parts: Column) -> Column:
        firsts = F.aggregate(parts, F.array(F.lit(0)), lambda done, rows: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(rows, -1)["stop"])))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("rows"), F.slice(firsts, 1, F.size(parts)).alias("first")), shifted))

    return _bound(zipped, lambda z: F.when(F.size(z) > 0, _bound(F.transform(_blocks(z), lambda rows: F.aggregate(rows, empty, add)), joined)).otherwise(empty))


def _apart(spans: Column, known: Column) -> Column:
    """The spans that share no character with the known ones, which are looked up by blocks."""

    def block(rows: Column) -> Column:
        return F.named_struct(F.lit("low"), F.array_min(F.transform(rows, lambda s: s["start"])), F.lit("high"), F.array_max(F.transform(rows, lambda s: s["stop"])), F.lit("rows"), rows)

    def meets(r: Column, b: Column) -> Column:
        return (b["low"] < r["stop"]) & (b["high"] > r["start"]) & F.exists(b["rows"], lambda s: (s["start"] < r["stop"]) & (s["stop"] > r["start"]))

    free = _bound(F.array_sort(known), lambda k: _bound(F.transform(_blocks(k), block), lambda blocks: F.filter(spans, lambda r: ~F.exists(blocks, lambda b: meets(r, b)))))
    return F.when((F.size(spans) > 0) & (F.size(known) > 0), free).otherwise(spans)


def _spans(text: Column, hint: Column, pattern: str, kind: int, good, group: int = 0) -> Column:
    """Spans of the matches whose value is good(); texts without the hint are not scanned."""
    found = F.transform(F.filter(_located(text, pattern, kind, group), lambda s: good(s["value"])), lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("kind"), s["kind"], F.lit("stop"), s["stop"]))
    return F.when(hint, found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _pieces(token: Column) -> Column:
    """The token cut into pieces of 4,096 characters, so that a long token's characters aren't held one by one all at once."""
    return F.regexp_extract_all(token, F.lit(".{1,4096}"), 0)


def mean_ratio(token: Column, models: Models) -> Column:
    """Mean log-likelihood ratio of the token's character pairs; a pair of equal ones has none."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in models.ratio)), ",").cast("array<double>")  # folded to a constant
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("sum"), F.lit(0.0))

    def step(acc: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        gain = F.when((acc["at"] > 0) & (at > 0) & (acc["at"] != at), F.element_at(table, (acc["at"] - 1) * size + at)).otherwise(F.lit(0.0))
        return F.named_struct(F.lit("at"), at, F.lit("sum"), acc["sum"] + gain)

    total = F.aggregate(_pieces(token), start, lambda acc, piece: F.aggregate(F.split(piece, ""), acc, step), lambda acc: acc["sum"])
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def stretch_ratio(token: Column, models: Models) -> Column:
    """Greatest sum, over stretches of at least STRETCH characters between JOINTS or ends, of what each pair's log-likelihood ratio is above models.least; null for a shorter token.

    Sums of pairs up to a character are kept beside those up to the character STRETCH - 1 before it, whose least so far
    is where the best stretch begins.
    """
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in models.ratio)), ",").cast("array<double>")  # folded to a constant
    none = F.lit(None).cast("double")
    joints = [ALPHABET.index(c) + 1 for c in JOINTS]
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("sum"), F.lit(0.0), F.lit("late_at"), F.lit(0), F.lit("late"), F.lit(0.0), F.lit("low"), none, F.lit("best"), none)

    def gain(a: Column, b: Column) -> Column:
        known = F.when(a == b, F.lit(-models.least)).otherwise(F.element_at(table, (a - 1) * size + b) - models.least)
        return F.when((a > 0) & (b > 0), known).otherwise(F.lit(0.0))

    def step(acc: Column, c: Column) -> Column:
        at, late_at = F.instr(F.lit(ALPHABET), c["c"]), F.instr(F.lit(ALPHABET), c["late"])
        total, late = acc["sum"] + gain(acc["at"], at), acc["late"] + gain(acc["late_at"], late_at)
        # a stretch begins at the first character or after a joint, and ends before a joint or with the token
        begins = (late_at > 0) & ((acc["late_at"] == 0) | acc["late_at"].isin(joints))
        low = F.when(begins, F.least(acc["low"], late)).otherwise(acc["low"])
        best = F.when(at.isin(joints), F.greatest(acc["best"], acc["sum"] - acc["low"])).otherwise(acc["best"])
        return F.named_struct(F.lit("at"), at, F.lit("sum"), total, F.lit("late_at"), late_at, F.lit("late"), late, F.lit("low"), low, F.lit("best"), best)

    def both(piece: Column) -> Column:
        chars = F.split(piece["now"], "")
        return F.arrays_zip(chars.alias("c"), F.slice(F.split(piece["late"], ""), F.lit(1), F.size(chars)).alias("late"))

    late = _pieces(F.concat(F.lit(" " * (STRETCH - 1)), token))
    paired = F.arrays_zip(_pieces(token).alias("now"), F.slice(late, F.lit(1), F.size(_pieces(token))).alias("late"))
    return F.aggregate(paired, start, lambda acc, piece: F.aggregate(both(piece), acc, step), lambda acc: F.greatest(acc["best"], acc["sum"] - acc["low"]))


def is_random(token: Column, models: Models) -> Column:
    """Whether the token as a whole, one of its parts or a stretch of them is a random string."""
    parts = F.exists(F.regexp_extract_all(token, F.lit(PART), 0), lambda p: mean_ratio(p, models) >= models.least)
    return token.rlike("[A-Za-z]") & ((mean_ratio(token, models) >= models.least) | parts | F.coalesce(stretch_ratio(token, models) >= 0, F.lit(False)))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, assign, access, hex, random) of each row of docs (doc_id, text): the spans of each kind."""
    text = F.coalesce("text", F.lit(""))
    always = F.lit(True)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        _spans(text, text.rlike(ASSIGN_HINT), ASSIGN, 0, lambda v: F.length(v) >= 6, 2).alias("assign"),
        _spans(text, text.contains("AKIA"), ACCESS, 1, lambda v: always).alias("access"),
        _spans(text, text.rlike(HEX), HEX, 2, lambda v: always).alias("hex"),
        _spans(text, text.rlike(CANDIDATE), CANDIDATE, 3, lambda v: is_random(v, models)).alias("random"),
    )
    return base.select("doc_id", "assign", "access", "hex", _apart(F.col("random"), F.concat("assign", "access", "hex")).alias("random"))


def report(docs: DataFrame, models: Models) -> DataFrame:
    """Counts, digest of the base spans, and all spans."""
    base = _listed(F.concat("assign", "access", "hex"))
    return scan(docs, models).select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        _listed(F.concat("assign", "access", "hex", "random")).alias("spans"),
    )
