"""Secrets in text: fixed patterns, and strings that a battery of randomness tests can't tell from noise.

A string without white space that mixes letters and digits is a candidate; ``=`` parts strings, and one that mixes
``+`` or ``/`` with ``-`` or ``_`` is parted too, as no alphabet holds all of them. Its encoding is the smallest known
alphabet that holds it. Three tests ask whether it may be uniform noise over that alphabet: chi-squared
of its symbol counts, the number of runs above and below the middle of the alphabet, and the serial
correlation of neighbours. The least p-value, times three, is the string's p-value. Within each class of
encoding and length (by powers of two) the Benjamini-Hochberg rule decides which strings are called
structured, so that among those at most a given share is noise; the others are reported.

All of it is column expressions: one pass counts p-values in a fixed number of bins per class, a second marks spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns: name, pattern, group whose length counts, least length. Listed order breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 8),
    # Maximal runs, so asking for the length in the pattern finds the same spans as dropping short ones.
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
# A whole run that one alphabet holds; else its pieces between ``/``, ``_`` and ``-``. ``=`` parts runs and belongs to one only as padding.
_RUN = "A-Za-z0-9+/_-"
_PADDING = f"(?:=++(?![{_RUN}]))?"
CANDIDATE = "|".join(f"{whole}{_PADDING}" for whole in (
    f"(?<![{_RUN}])[A-Za-z0-9+/]{{20,}}+(?![{_RUN}])", f"(?<![{_RUN}])[A-Za-z0-9_-]{{20,}}+(?![{_RUN}])", "[A-Za-z0-9+]{20,}+",
))

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets in the order in which they are tried; each has an even number of symbols.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
LEVEL = 0.05
BINS = 10_000
_BLOCK = 512


def running(lengths: Column) -> Column:
    """Running sums of an array of longs. Worked out in blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def sums(xs: Column, start: Column) -> Column:
        empty = F.struct(F.array().cast("array<bigint>").alias("out"), start.alias("at"))
        step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"] + x)).alias("out"), (s["at"] + x).alias("at"))
        return F.aggregate(xs, empty, step)["out"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK)), lambda b: F.slice(lengths, (b * _BLOCK + 1).cast("int"), _BLOCK))
    starts = F.concat(F.array(zero), sums(F.transform(blocks, total), zero))
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(blocks, starts, lambda b, s: F.when(s.isNotNull() & b.isNotNull(), sums(b, s)).otherwise(F.array().cast("array<bigint>")))))


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches of a pattern that do not overlap: array of (piece before it, match)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    return F.arrays_zip(before.alias("before"), matches.alias("match"))


def _spans(found: Column, kind: str) -> Column:
    """Spans in code points, ends exclusive, of what ``located`` gives."""
    sizes = F.transform(found, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("long"))
    return F.when(F.size(found) > 0, F.zip_with(found, running(sizes), lambda x, end: F.struct(
        (end - F.length(x["match"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"),
    ))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, kind: string, match: string>>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        out = F.when(F.translate(token, ENCODINGS[k][1], "") == "", F.lit(k)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """Struct of encoding (number in ``ENCODINGS``, null if none), length class and p-value under uniform noise."""
    bare = F.rtrim(F.translate(token, "=", " "))
    alphabet = F.array(*[F.lit(a) for _, a in ENCODINGS])

    def measured(s: Column) -> Column:
        size = F.size(s["symbols"]).cast("double")
        letters = F.length(s["alphabet"]).cast("double")
        places = F.transform(s["symbols"], lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
        counts = F.transform(F.array_distinct(s["symbols"]), lambda c: F.length(s["bare"]) - F.length(F.replace(s["bare"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        return F.struct(s["encoding"].alias("encoding"), size.alias("size"), letters.alias("letters"), places.alias("places"), squares.alias("squares"))

    def tested(s: Column) -> Column:
        n, k, middle = s["size"], s["letters"], (s["letters"] - 1) / 2
        free = k - 1
        chi = k / n * s["squares"] - n
        spread = 2 / (9 * free)
        uneven = normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, 1 / 3) - (1 - spread)) / F.sqrt(spread))
        pairs = F.zip_with(F.slice(s["places"], F.lit(1), (n - 1).cast("int")), F.slice(s["places"], F.lit(2), (n - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
        product = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["a"] - middle) * (p["b"] - middle))
        runs = 2 * normal_tail(F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        serial = 2 * normal_tail(F.abs(product / ((k * k - 1) / 12) / F.sqrt(n - 1)))
        return F.struct(
            s["encoding"].alias("encoding"), F.floor(F.log2(n)).cast("int").alias("octave"),
            F.least(F.lit(1.0), 3 * F.least(uneven, runs, serial)).alias("p"),
        )

    start = F.array(F.struct(bare.alias("bare"), F.split(bare, "").alias("symbols"), _encoding(bare).alias("encoding"), F.element_at(alphabet, _encoding(bare) + 1).alias("alphabet")))
    # One-element arrays name a value once, so that nothing is worked out twice.
    return F.element_at(F.transform(F.transform(start, measured), tested), 1)


def _bin(p: Column) -> Column:
    return F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int")


def _class(test: Column) -> Column:
    return test["encoding"] * 64 + test["octave"]


def _candidates(found: Column) -> Column:
    return F.filter(found, lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]") & (F.length(F.translate(x["match"], "=", "")) >= 20))


def thresholds(docs: DataFrame, text: str = "text", level: float = LEVEL) -> DataFrame:
    """One row: ``limits``, a map from class to the last bin of p-values called structured.

    At most encodings times lengths times bins rows are ordered, whatever the number of strings.
    """
    text_column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = docs.select(F.explode(F.transform(_candidates(located(text_column, CANDIDATE)), lambda x: x["match"])).alias("token"))
    tests = tokens.select(battery(F.col("token")).alias("test")).where("test.encoding IS NOT NULL")
    bins = tests.groupBy(_class(F.col("test")).alias("class"), _bin(F.col("test.p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select("class", "bin", F.sum("n").over(up).alias("below"), F.sum("n").over(Window.partitionBy("class")).alias("all"))
    # The step-up rule, with each p-value counted as the upper end of its bin.
    passed = bins.where((F.col("bin") + 1) / F.lit(BINS) <= level * F.col("below") / F.col("all"))
    limits = passed.groupBy("class").agg(F.max("bin").alias("bin"))
    return limits.agg(F.map_from_entries(F.collect_list(F.struct("class", "bin"))).alias("limits"))


def scan(docs: DataFrame, text: str = "text", level: float = LEVEL) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, end, kind, match), by start, then kind as listed, ``random`` last.

    Offsets are code points, ends exclusive. Null and empty texts have no secrets. Random spans that touch a
    fixed pattern's span are left to it. Repeated rows are scanned each; they count each in the false-discovery
    rule. A column of ``docs`` named ``secrets`` is replaced; others stay as they are.
    """
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names if c.lower() != "secrets"]).alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    for kind, pattern, _, _ in BASE:
        rows = rows.withColumn(f"at_{kind}", located(F.col("text"), pattern))
    rows = rows.withColumn("at_random", located(F.col("text"), CANDIDATE)).drop("text")
    for kind, pattern, group, least in BASE:
        spans = _spans(F.col(f"at_{kind}"), kind)
        if group:
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least)
        rows = rows.withColumn(f"at_{kind}", spans)
    rows = rows.withColumn("base", F.concat(*[F.col(f"at_{kind}") for kind, *_ in BASE])).drop(*[f"at_{kind}" for kind, *_ in BASE])
    # Only rows with a candidate work out where it lies.
    spans = F.when(F.size(_candidates(F.col("at_random"))) > 0, _candidates(_spans(F.col("at_random"), "random")))
    rows = rows.withColumn("at_random", F.coalesce(spans, F.array().cast("array<struct<start: bigint, end: bigint, kind: string, match: string>>")))
    rows = rows.crossJoin(F.broadcast(thresholds(docs, text, level)))  # one row, at most 512 entries
    clear = F.filter("at_random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    noise = lambda s: F.element_at(
        F.transform(F.array(battery(s["match"])), lambda t: t["encoding"].isNotNull() & (_bin(t["p"]) > F.coalesce(F.try_element_at(F.col("limits"), _class(t)), F.lit(-1)))), 1
    )
    order = F.create_map(*[F.lit(x) for k, kind in enumerate([*(b[0] for b in BASE), "random"]) for x in (kind, k)])
    both = F.concat(F.col("base"), F.filter(clear, noise))
    ranked = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"))))
    secrets = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    # Two steps: a column of ``docs`` may have any name, also one that is in use here.
    return rows.select("row", secrets.alias("secrets")).select("row.*", "secrets")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
