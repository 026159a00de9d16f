"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.common import text_of
from sitemill.session import materialize

# The patterns of the base. The first one's letters count in either case.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

#: Runs that are tested for randomness.
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Inferred encoding: the first whose pattern holds and whose parts all occur. Its alphabet gives the ranks.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS: list[tuple[str, str, list[str], str]] = [
    ("hex", "^[0-9a-f]+$", ["[0-9]", "[a-f]"], _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", ["[0-9]", "[A-F]"], _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", ["[2-7]", "[A-Z]"], _UPPER + "234567"),
    ("upper36", "^[A-Z0-9]+$", ["[0-9]", "[A-Z]"], _DIGITS + _UPPER),
    ("lower36", "^[a-z0-9]+$", ["[0-9]", "[a-z]"], _DIGITS + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", ["[0-9]", "[A-Z]", "[a-z]"], _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+=*$", ["[0-9]", "[A-Z]", "[a-z]"], _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", ["[0-9]", "[A-Z]", "[a-z]"], _UPPER + _LOWER + _DIGITS + "-_"),
]
#: For what fits none of those, without its padding: digits or letters only, and the alphabets with separators where a class is missing.
FURTHER: list[tuple[str, str, list[str], str]] = [
    ("digits", "^[0-9]+$", [], _DIGITS),
    ("upper26", "^[A-Z]+$", [], _UPPER),
    ("lower26", "^[a-z]+$", [], _LOWER),
    ("base52", "^[A-Za-z]+$", [], _UPPER + _LOWER),
    ("base64 part", "^[A-Za-z0-9+/]+$", [], _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url part", "^[A-Za-z0-9_-]+$", [], _UPPER + _LOWER + _DIGITS + "-_"),
]
EVERY = ENCODINGS + FURTHER
#: Runs of one alphabet inside a run that fits no encoding of several classes, or in which a word stands between separators.
PARTS = ["[A-Za-z0-9_-]{16,}={0,2}", "[A-Za-z0-9+/]{16,}={0,2}", "[A-Za-z0-9]{16,}={0,2}"]
WORDY = "(?:^|[+/_-])[A-Za-z]?[a-z]{3,}(?:[+/_-]|$)"
#: Lengths that are judged together start here.
LENGTHS = [16, 24, 32, 48, 64, 128]
#: Steps of the threshold, and the share of false discoveries that each stratum may hold.
STEPS, FALSE_SHARE = 20, 0.1
#: Elements of an array that are folded at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers (sums, or highest ones), at a cost in proportion to its length.

    A fold that appends copies what it has so far. So totals run inside blocks, then over the
    blocks, whose copies are as many times fewer as a block is long.
    """

    def inside(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(add(acc["at"], x))).alias("all")), lambda acc: acc["all"])

    def in_blocks(parts: Column) -> Column:
        before = let(F.transform(parts, lambda xs: F.element_at(xs, -1)), lambda ends: F.concat(F.array(F.lit(0)), F.slice(inside(ends), F.lit(1), F.size(ends) - 1)))
        return F.flatten(F.zip_with(parts, before, lambda xs, b: F.transform(xs, lambda x: add(b, x))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, inside(v)).otherwise(let(F.transform(blocks(v), inside), in_blocks)))


def ends_of(gaps: Column, sizes: Column) -> Column:
    """Running ends of the matches, from the lengths of the texts between them and their own."""
    return running(F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: g + s), lambda a, b: a + b)


def matches(text: str | Column, pattern: str, group: int = 0) -> Column:
    """Matches, leftmost and non-overlapping, as an array of ``start, end, value`` (the group); null without one.

    The texts between the matches tell where they are: ``split`` and ``regexp_extract_all`` find the
    same matches. Most texts have none and are only searched once.
    """
    text = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.transform(whole, F.length)
    ends = ends_of(F.transform(F.split(text, pattern, -1), F.length), sizes)
    spans = F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    both = F.zip_with(spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), both)


def kind_of(found: Column, kind: int) -> Column:
    """Spans as ``start, kind, end``; kinds by number sort as listed."""
    return F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))), F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def fitting(token: Column, encodings: list) -> Column:
    """Number of the first encoding that fits; null when none does."""
    found = F.lit(None).cast("int")
    for i, (_, pattern, parts, _) in reversed(list(enumerate(encodings))):
        fits = token.rlike(pattern)
        for part in parts:
            fits = fits & token.rlike(part)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def encoding_of(token: Column) -> Column:
    """Number of the inferred encoding; null when the token mixes ``+/`` with ``_-``."""
    return F.coalesce(fitting(token, ENCODINGS), fitting(F.rtrim(token, F.lit("=")), EVERY))


def units(found: Column) -> Column:
    """What is tested of the matches: each as a whole, or, where it may hold more than a key, its longest runs of each alphabet.

    A run that mixes ``+/`` with ``_-`` or lacks a class of characters, and one with a word between
    separators (a path, a prefix), is cut; runs of two alphabets may overlap, equal ones come once.
    """

    def cut(m: Column) -> Column:
        value, none = m["value"], F.array().cast("array<struct<start:int,end:int,value:string>>")
        whole = F.struct(m["start"].alias("start"), m["end"].alias("end"), value.alias("value"))
        inner = F.concat(*[F.coalesce(matches(value, p), none) for p in PARTS])
        moved = F.transform(inner, lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["value"].alias("value")))
        mixed = value.rlike("[+/_-]") & (fitting(value, ENCODINGS).isNull() | value.rlike(WORDY))
        return F.when(mixed, F.array_sort(F.array_distinct(moved))).otherwise(F.array(whole))

    return F.flatten(F.transform(found, cut))


def longest(spans: Column) -> Column:
    """Of overlapping spans (sorted by start) the longer; the earlier of equal ones."""
    kind = "struct<start:int,end:int>"

    def add(state: Column, t: Column) -> Column:
        last = state["last"]
        apart = last.isNull() | (last["end"] <= t["start"])
        kept = F.when(apart & last.isNotNull(), F.concat(state["kept"], F.array(last))).otherwise(state["kept"])
        return F.struct(F.when(apart | (last["end"] - last["start"] < t["end"] - t["start"]), t).otherwise(last).alias("last"), kept.alias("kept"))

    def block(state: Column, ts: Column) -> Column:
        start = F.struct(state["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
        return let(F.aggregate(ts, start, add), lambda x: F.struct(x["last"].alias("last"), F.concat(state["done"], F.array(x["kept"])).alias("done")))

    def fold(plain: Column) -> Column:
        start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        return F.aggregate(blocks(plain), start, block, lambda x: F.concat(F.flatten(x["done"]), F.array(x["last"])))

    plain = F.transform(spans, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return let(plain, lambda ts: F.when(F.size(ts) < 2, ts).otherwise(fold(ts)))


def apart_from(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no span of ``base``, ordered by their ends.

    A span that starts before a token's end overlaps it when it ends behind the token's start. So
    starts of spans and ends of tokens are put in one order, and the highest end of a span so far is compared.
    """
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("span"), b["end"].alias("reach"), F.lit(None).cast("struct<start:int,end:int>").alias("token")))
    ends = F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("span"), F.lit(0).alias("reach"), F.struct(t["start"].alias("start"), t["end"].alias("end")).alias("token")))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        both = F.zip_with(events, reach, lambda e, r: F.struct(e["token"].alias("token"), r.alias("reach")))
        return F.transform(F.filter(both, lambda e: e["token"].isNotNull() & (e["reach"] <= e["token"]["start"])), lambda e: e["token"])

    plain = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), plain).otherwise(let(F.array_sort(F.concat(spans, ends)), free))


def by_encoding(number: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number + 1)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, off by 2e-4 at most)."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070566 * z * z * z)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def tested(found: Column) -> Column:
    """Matches with an encoding, ``hash`` of the token, and ``p``: how well the token agrees with independent, uniform characters.

    Chi-squared test of equal use of the alphabet, runs test of lower and upper half of the alphabet,
    and serial correlation of neighbours; the three p-values are combined as Fisher does.
    """
    coded = F.filter(
        F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.rtrim(m["value"], F.lit("=")).alias("token"), encoding_of(m["value"]).alias("code"))),
        lambda m: m["code"].isNotNull(),
    )
    ranked = F.transform(
        coded,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["code"].alias("code"),
            F.xxhash64(m["token"]).alias("hash"),
            F.length(m["token"]).cast("double").alias("n"),
            by_encoding(m["code"], [float(len(e[3])) for e in EVERY]).alias("size"),
            F.transform(F.array_distinct(F.split(m["token"], "")), lambda c: F.length(m["token"]) - F.length(F.replace(m["token"], c, F.lit("")))).alias("counts"),
            F.transform(F.split(m["token"], ""), lambda c: F.position(c, by_encoding(m["code"], [e[3] for e in EVERY])).cast("double")).alias("ranks"),
        ),
    )
    summed = F.transform(
        ranked,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["code"].alias("code"),
            m["hash"].alias("hash"),
            m["n"].alias("n"),
            m["size"].alias("size"),
            total(F.transform(m["counts"], lambda c: c.cast("double") * c)).alias("squares"),
            total(F.transform(m["ranks"], lambda r: F.when(r > m["size"] / 2, 1.0).otherwise(0.0))).alias("high"),
            total(
                F.zip_with(F.slice(m["ranks"], F.lit(1), F.size(m["ranks"]) - 1), F.slice(m["ranks"], F.lit(2), F.size(m["ranks"]) - 1), lambda a, b: F.when((a > m["size"] / 2) != (b > m["size"] / 2), 1.0).otherwise(0.0))
            ).alias("turns"),
            total(
                F.zip_with(
                    F.slice(m["ranks"], F.lit(1), F.size(m["ranks"]) - 1),
                    F.slice(m["ranks"], F.lit(2), F.size(m["ranks"]) - 1),
                    lambda a, b: (a - (m["size"] + 1) / 2) * (b - (m["size"] + 1) / 2),
                )
            ).alias("products"),
        ),
    )

    def statistics(m: Column) -> Column:
        n, size, high = m["n"], m["size"], m["high"]
        chi = size / n * m["squares"] - n
        uniform = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        mean = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        runs = F.abs(m["turns"] + 1 - mean) / spread
        serial = F.abs(m["products"]) / ((size * size - 1) / 12 * F.sqrt(n - 1))
        least = F.lit(1e-12)
        log = F.ln(F.greatest(least, tail(uniform))) + F.ln(F.greatest(least, F.least(F.lit(1.0), 2 * tail(runs)))) + F.ln(F.greatest(least, F.least(F.lit(1.0), 2 * tail(serial))))
        long = sum([F.when(n >= x, 1).otherwise(0) for x in LENGTHS[1:]], F.lit(0))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hash"].alias("hash"), (m["code"] * len(LENGTHS) + long).alias("stratum"), (F.exp(log) * (1 - log + log * log / 2)).alias("p"))

    return F.transform(summed, statistics)


def thresholds(tokens: DataFrame) -> DataFrame:
    """``stratum, least_p``: tokens from there on are taken as random.

    A stratum is an encoding and a length class. Random tokens have p spread evenly, others have it
    near 0; so twice those above a half tell how many are random, and the threshold is the smallest
    at which no more than ``FALSE_SHARE`` of what is taken is expected to be something else.
    The estimate needs independent tokens, so equal ones (by 64-bit hash, as p follows from the token)
    count once, however often they are copied. Counts are a row per stratum and step, at most 1,680,
    whatever the table holds.
    """
    step = F.least(F.lit(STEPS - 1), F.floor(F.col("p") * STEPS)).cast("int")
    counts = tokens.select("stratum", "hash", step.alias("step")).distinct().groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("stratum")
    random = F.sum(F.when(F.col("step") >= STEPS // 2, F.col("n")).otherwise(0)).over(every) * 2
    taken = F.sum("n").over(every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    least = F.col("step") / float(STEPS)
    rated = counts.select("stratum", "step", random.alias("random"), taken.alias("taken"))
    wrong = 1 - (1 - least) * F.col("random") / F.col("taken")
    return rated.where((wrong <= FALSE_SHARE) & (F.col("random") > 0)).groupBy("stratum").agg(F.min(least).alias("least_p"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", by_encoding(s["kind"], KINDS), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``found`` (spans ``start, kind, end``, ordered), ``row``.

    ``base`` holds the matches of the fixed patterns; ``found`` adds tokens that the tests take as
    random and that overlap none of them; of two that overlap, the longer. A null or empty text has none. Rows are scanned one by
    one, repeated ids too. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    assign = F.filter(matches("text", ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(kind_of(assign, 0), kind_of(matches("text", ACCESS), 1), kind_of(matches("text", HEX), 2)))
    seen = materialize(
        rows.select("row", "doc_id", base.alias("base"), matches("text", CANDIDATE).alias("tokens")).select("row", "doc_id", "base", tested(units(F.col("tokens"))).alias("tokens")), "secret-spans"
    )
    limits = thresholds(seen.select(F.explode("tokens").alias("t")).select("t.stratum", "t.hash", "t.p"))
    known = {r["stratum"]: r["least_p"] for r in limits.collect()}  # at most one per stratum
    limit = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]) if known else F.create_map().cast("map<int,double>")
    likely = F.filter(F.col("tokens"), lambda t: t["p"] >= limit[t["stratum"]])
    free = F.array_sort(apart_from(F.col("base"), likely))
    return seen.select("row", "doc_id", "base", F.array_sort(F.concat("base", kind_of(longest(free), 3))).alias("found"))


KIND_IS = [lambda x: x == 0, lambda x: x == 1, lambda x: x == 2]


def digest(spans: DataFrame) -> DataFrame:
    """Counts per kind, the base's digest, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, KIND_IS[k])).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
