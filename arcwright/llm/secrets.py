"""Secret scans with DataFrame functions alone.

Base rules find assignments, access keys and hexadecimal runs.  Beside them a battery of
randomness tests looks at every long token.  The encoding is inferred from its letters, and
the token is held against uniform draws of that alphabet: chi-squared on the letter counts
(through the number of equal pairs of letters, whose tail is Poisson's while few are
expected, and normal beyond), runs of letters above and below the middle of the alphabet,
and the lag-one serial correlation.  Fisher's rule makes one p-value of the three.

Random tokens have p-values spread evenly over 0..1, and text has them near 0.  So within
each encoding and length band the number m of p-values above 1/2 tells how many tokens are
random: about 2 m, of which 1 - c exceed a cut c.  Of the N(c) tokens above c the others are
false.  The least cut with

    N(c) - 2 (m - 1) (1 - c) <= FDR * N(c)

is taken, and tokens above it are reported.  The one taken off m counts on the false side.
Bands with fewer than 1 / FDR tokens above 1/2 are pooled within their encoding, and a pool
with fewer than that reports nothing.  m scatters by about its root,
so the share of false tokens is held on average over bands and not in each; tokens of text
with p above 1/2 count as random ones, and the battery is what keeps them few.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.1  # most of the reported tokens of a band that may be no random ones
FEW_RANDOM = 10  # 1 / FDR: fewer p-values above 1/2 tell too little
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
FEW_PAIRS = 200.0  # beyond so many expected equal pairs their number counts as normal

_SPANS = "array<struct<start:int,end:int>>"


def _located(text: Column, pattern: str, guard: Column, keep: tuple[int, int]) -> Column:
    """Spans of the leftmost non-overlapping matches; ``keep`` = (group, least length).

    The pieces between the matches come from ``split`` with the same pattern, so running
    sums over the lengths of pieces and matches are the offsets, in code points.
    """
    group, least = keep
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(
        F.transform(pieces, lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("len"),
        F.transform(part, lambda x: F.length(x) >= least).alias("ok"),
    )
    ends = _let(F.transform(steps, lambda s: s["gap"] + F.coalesce(s["len"], F.lit(0))), _running)
    found = _let(steps, lambda x: F.filter(F.transform(ends, lambda e, i: F.struct((e - x[i]["len"]).alias("start"), e.alias("end"), x[i]["ok"].alias("ok"))), lambda y: y["ok"]))
    spans = F.transform(found, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end")))
    return F.coalesce(F.when(guard, spans), F.array().cast(_SPANS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(x: Column) -> Column:
    """Running sums of an array of numbers.

    An array that grows by one element a step costs the square of its length, so sums run
    within blocks of about the root of the length, and then over the blocks.
    """
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    sums = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda acc, y: F.concat(acc, F.array(last(acc) + y)))
    blocks = _let(size, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), n), lambda a: sums(F.slice(x, a, n))))
    whole = lambda b: _let(sums(F.transform(b, last)), lambda t: F.flatten(F.transform(b, lambda y, i: F.transform(y, lambda v: v + F.when(i > 0, F.get(t, i - 1)).otherwise(0)))))
    return _let(blocks, whole)


def _encoding(bare: Column) -> Column:
    return (
        F.when(bare.rlike(r"^([0-9a-f]+|[0-9A-F]+)$") & bare.rlike("[0-9]") & bare.rlike("[A-Fa-f]"), F.lit("hex"))
        .when(bare.rlike(r"^[A-Z2-7]+$") & bare.rlike("[2-7]"), F.lit("base32"))
        .when(bare.rlike(r"^[A-Za-z0-9]+$"), F.lit("base62"))
        .otherwise(F.lit("base64"))
    )


_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _two_sided(z: Column) -> Column:
    """Chance of a standard normal beyond |z| (Abramowitz and Stegun 7.1.26)."""
    x = F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-30))


def _pairs_tail(pairs: Column, mean: Column, k: Column) -> Column:
    """Two-sided chance of so many equal pairs of letters when ``mean`` are expected."""
    term = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("below"))
    steps = F.sequence(F.lit(1), F.least(pairs, 10 * mean + 100).cast("int"))
    # below: P(X < pairs); term: P(X = pairs)
    walked = F.when(pairs < 1, term).otherwise(F.aggregate(steps, term, lambda a, i: F.struct((a["term"] * mean / i).alias("term"), (a["below"] + a["term"]).alias("below"))))
    poisson = _let(walked, lambda w: F.least(F.lit(1.0), 2 * F.least(F.greatest(1 - w["below"], F.lit(1e-30)), F.greatest(w["below"] + w["term"], F.lit(1e-30)))))
    return F.when(mean <= FEW_PAIRS, F.when(pairs > 10 * mean + 100, 1e-30).otherwise(poisson)).otherwise(_two_sided((pairs - mean) / F.sqrt(mean * (1 - 1 / k))))


def _battery(token: Column) -> Column:
    """struct(encoding, band, p, bin): the combined p-value, and how many of CUTS it exceeds.

    All sums are one fold over the letters and one count for each letter of the alphabet,
    so the time is in proportion to the token's length.
    """

    def bound(bare: Column) -> Column:
        return _let(_encoding(bare), lambda e: facts(bare, e))

    def facts(bare: Column, encoding: Column) -> Column:
        same_case = F.when(encoding == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
        alphabet = F.when(encoding == "hex", _ALPHABETS["hex"]).when(encoding == "base32", _ALPHABETS["base32"]).when(encoding == "base62", _ALPHABETS["base62"]).otherwise(_ALPHABETS["base64"])
        k = F.when(encoding == "hex", 16.0).when(encoding == "base32", 32.0).when(encoding == "base62", 62.0).otherwise(64.0)
        return _let(F.struct(same_case.alias("s"), alphabet.alias("a"), k.alias("k"), F.length(same_case).cast("double").alias("n"), encoding.alias("e")), sums)

    def sums(x: Column) -> Column:
        squares = F.aggregate(F.split(x["a"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(x["n"] - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2.0)))
        zero = F.lit(0.0)
        start = F.struct(*[zero.alias(c) for c in ("high", "runs", "s1", "s2", "s11", "first", "last")])

        def step(acc: Column, c: Column) -> Column:
            return _let(F.position(c, x["a"]).cast("double"), lambda v: moved(acc, v))

        def moved(acc: Column, v: Column) -> Column:
            begun = acc["last"] > 0
            change = F.when(begun & ((acc["last"] * 2 > x["k"]) == (v * 2 > x["k"])), 0.0).otherwise(1.0)
            return F.struct(
                (acc["high"] + F.when(v * 2 > x["k"], 1.0).otherwise(0.0)).alias("high"),
                (acc["runs"] + change).alias("runs"),
                (acc["s1"] + v).alias("s1"),
                (acc["s2"] + v * v).alias("s2"),
                (acc["s11"] + acc["last"] * v).alias("s11"),
                F.when(begun, acc["first"]).otherwise(v).alias("first"),
                v.alias("last"),
            )

        letters = F.filter(F.split(x["s"], ""), lambda c: c != "")
        return _let(F.struct(x.alias("x"), squares.alias("q"), F.aggregate(letters, start, step).alias("w")), lambda y: tests(y["x"], y["q"], y["w"]))

    def tests(x: Column, squares: Column, w: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = _pairs_tail((squares - n) / 2, n * (n - 1) / (2 * k), k)
        both = 2 * w["high"] * (n - w["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, _two_sided((w["runs"] - both / n - 1) / F.sqrt(spread))).otherwise(1e-30)
        mean = w["s1"] / n
        around = w["s2"] - n * mean * mean
        lag = w["s11"] - mean * (2 * w["s1"] - w["first"] - w["last"]) + (n - 1) * mean * mean
        serial = F.when(around > 0, _two_sided((lag / around + 1 / n) * F.sqrt(n))).otherwise(1e-30)
        fisher = lambda g: F.exp(-g) * (1 + g + g * g / 2)
        p = _let(-(F.log(chi) + F.log(runs) + F.log(serial)), fisher)
        return _let(p, lambda v: F.struct(x["e"].alias("encoding"), F.floor(F.log2(n)).cast("int").alias("band"), v.alias("p"), sum((F.when(v > c, 1).otherwise(0) for c in CUTS), F.lit(0)).alias("bin")))

    return _let(F.rtrim(token, F.lit("=")), bound)


def fdr_cuts(tokens: DataFrame) -> dict[str, int]:
    """The least number of CUTS to exceed, by encoding and length band; none where no cut holds.

    ``tokens`` has the columns encoding, band, bin.  The driver sees one row for each of at
    most 4 encodings x 31 bands, whatever the corpus.  The rule stands at the module's head.
    """
    numbers = [f"n{i}" for i in range(len(CUTS))]
    grid = tokens.groupBy("encoding", "band").agg(*[F.count_if(F.col("bin") > i).alias(n) for i, n in enumerate(numbers)])
    few = F.col(numbers[-1]) < FEW_RANDOM
    pools = grid.groupBy("encoding", F.when(few, -1).otherwise(F.col("band")).alias("pool")).agg(F.collect_list("band").alias("bands"), *[F.sum(n).alias(n) for n in numbers])
    random = 2.0 * (F.col(numbers[-1]) - 1)
    ok = [F.when(~few & (F.col(n) - random * (1 - c) <= FDR * F.col(n)), i + 1) for i, (n, c) in enumerate(zip(numbers, CUTS, strict=True))]
    cuts = pools.select("encoding", F.explode("bands").alias("band"), F.coalesce(*ok).alias("cut")).filter("cut is not null")
    return {f"{r['encoding']}:{r['band']}": r["cut"] for r in cuts.collect()}


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of ``docs(doc_id, text)``.

    Returns one row per row of ``docs``: doc_id and, for each of the kinds assign, access,
    hex and random, an array of (start, end) in code points, end exclusive.  A null text is
    an empty one.  Repeated rows are scanned one by one; other columns are ignored.  Long
    tokens and texts with many spans take time in proportion to their length, or nearly so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    tokens = rows.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    cuts = fdr_cuts(tokens.select(_battery(F.col("token")).alias("t")).select("t.*"))
    x = F.col("text")
    found = rows.select(
        "doc_id",
        "text",
        _located(x, ASSIGN, x.contains(":") | x.contains("="), (2, 12)).alias("assign"),
        _located(x, ACCESS, x.contains("AKIA"), (0, 18)).alias("access"),
        _located(x, HEX, x.rlike(HEX), (0, 16)).alias("hex"),
        _located(x, TOKEN, x.rlike(TOKEN), (0, 20)).alias("long"),
    )
    if cuts:
        table = F.create_map(*[y for k, v in sorted(cuts.items()) for y in (F.lit(k), F.lit(v))])

        def random(s: Column) -> Column:
            t = _battery(F.substring("text", s["start"] + 1, s["end"] - s["start"]))
            return _let(t, lambda y: y["bin"] >= F.coalesce(F.try_element_at(table, F.concat_ws(":", y["encoding"], y["band"].cast("string"))), F.lit(len(CUTS) + 1)))

        found = found.withColumn("random", F.filter("long", random))
    else:
        found = found.withColumn("random", F.array().cast(_SPANS))
    return found.select("doc_id", *KINDS)


def _listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    def tagged(turn: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(turn).alias("turn"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_join(F.transform(F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)])), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listing(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _listing(KINDS).alias("spans"),
    )
