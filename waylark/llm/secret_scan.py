"""Secret scans by patterns and a battery of randomness tests, in built-in functions only.

Three kinds of spans come from patterns: assignments to names of secrets, access keys
and long hexadecimal runs. Further ones, of kind ``random``, are found among runs of
letters, digits and signs that no such span touches. Each gets the encoding that its
letters and digits allow (hexadecimal, base 32, base 64), or is left alone, and three
tests within it:

* chi-squared: how unevenly the alphabet is used;
* runs: how often neighbours differ in class (lower case, upper case, other);
* serial correlation: how much a value tells of the next.

Each statistic is held against two expectations, that of uniformly random values and
that of ordinary words, names and numbers (``ORDINARY``). A run that any test finds not
random (beyond LIMIT deviations) is none. What is left of the three deviations from
the ordinary is added up (Stouffer), and its tail, bounded from above, is the p-value of
"this is ordinary". These are controlled for false discoveries (Benjamini and Hochberg)
in each class of lengths for itself: the tests of short runs have little power, and
neither the many short ones nor the few long ones should set the other's threshold. The
step-up runs over a histogram of p-values, which has few rows at any size.

A text's spans and statistics are one small row of arrays; texts don't travel. Positions
come from the lengths of what lies between matches, by running sums in blocks, so that
a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The patterns of the base kinds, in order. Letters of names are spelt in both cases.
NAMES = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is greedy and what follows its first AKIA is the longest, so that a least length in the pattern finds what a later test would leave.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "random")

#: Runs of so many characters or more are tested.
LEAST = 20
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Alphabets in the order of their values; hexadecimal runs are put in lower case, and - and _ count as + and /.
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Of random values the share of neighbours of different classes: of 6 letters and 10 digits, of 26 and 6, of 26, 26 and 12.
CHANGES = {16: 2 * 6 * 10 / 256, 32: 2 * 26 * 6 / 1024, 64: 1 - (2 * 26**2 + 12**2) / 4096}
#: Of ordinary text in each encoding: the chance that two characters are equal, the share of neighbours of different classes, and the serial correlation.
ORDINARY = {16: (0.1, 0.15, 0.35), 32: (0.066, 0.1, 0.35), 64: (0.05, 0.33, 0.35)}
#: Deviations from randomness beyond which a run isn't random.
LIMIT = 4.0
#: The share of false discoveries, and the least length of each class of lengths.
ALPHA, CLASSES = 0.001, (20, 32, 64, 128)
#: Bins of a unit of -ln p, and the last one.
BINS, LAST_BIN = 100, 20_000
#: Characters whose neighbours are looked at together; pairs across two pieces aren't counted.
PIECE = 4096
#: Entries of a block of a running sum.
BLOCK = 256
FAR = 1 << 62


def running(df: DataFrame, name: str, merge: Callable[[Column, Column], Column], seed: int) -> DataFrame:
    """``df`` with each entry of its array<bigint> ``name`` merged with all before it. In blocks, as an array is copied when it grows."""
    x = F.col(name)
    start = F.array(F.lit(seed).cast("long"))
    grown = lambda a, v: F.concat(a, F.array(merge(F.element_at(a, -1), v)))
    blocks = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK)))
    within = F.transform(blocks, lambda block: F.slice(F.aggregate(block, start, grown), 2, BLOCK))
    out = df.withColumn("_w", within)
    ends = F.aggregate(F.transform("_w", lambda w: F.element_at(w, -1)), start, grown)
    zipped = F.arrays_zip(F.col("_w").alias("w"), F.slice(ends, F.lit(1), F.size("_w")).alias("o"))
    merged = F.flatten(F.transform(zipped, lambda z: F.transform(z["w"], lambda v: merge(z["o"], v))))
    return out.withColumn(name, F.coalesce(merged, F.array().cast("array<bigint>"))).drop("_w")


def found(df: DataFrame, text: str, name: str, pattern: str, cheap: str) -> DataFrame:
    """``df`` with ``name``: array of (start, end, hit) of the leftmost matches that don't overlap, in code points. A text without ``cheap`` isn't split."""
    t = F.col(text)
    p = F.lit(pattern)
    df = df.withColumn("_hits", F.when(t.rlike(cheap), F.regexp_extract_all(t, p, F.lit(0))))
    df = df.withColumn("_n", F.coalesce(F.size("_hits"), F.lit(0)))
    between = F.when(F.col("_n") > 0, F.transform(F.slice(F.split(t, pattern, -1), F.lit(1), F.col("_n")), lambda s: F.length(s).cast("long")))
    lengths = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice("_hits", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))), lambda h: F.length(h).cast("long")))
    df = df.withColumn("_at", F.coalesce(F.zip_with(between, lengths, lambda a, b: a + b), F.array().cast("array<bigint>")))
    df = running(df, "_at", lambda a, b: a + b, 0)
    spans = F.transform(F.arrays_zip(F.col("_at").alias("s"), F.coalesce("_hits", F.array().cast("array<string>")).alias("h")), lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.length(z["h"])).alias("end"), z["h"].alias("hit")))
    return df.withColumn(name, spans).drop("_hits", "_n", "_at")


def encoding(run: Column) -> Column:
    """16, 32 or 64, or null. A run of digits alone is a number, and one without digits a word; base 64 needs both cases."""
    digit = run.rlike("[0-9]")
    return (
        F.when(digit & run.rlike("^[0-9a-f]+$") & run.rlike("[a-f]") | digit & run.rlike("^[0-9A-F]+$") & run.rlike("[A-F]"), 16)
        .when(run.rlike("^[A-Z2-7]+$") & digit, 32)
        .when(digit & run.rlike("[a-z]") & run.rlike("[A-Z]") & (run.rlike("^[A-Za-z0-9+/]+$") | run.rlike("^[A-Za-z0-9_-]+$")), 64)
    )


def by_encoding(k: Column, values: dict[int, float | str]) -> Column:
    return F.when(k == 16, F.lit(values[16])).when(k == 32, F.lit(values[32])).otherwise(F.lit(values[64]))


def plain(run: Column, k: Column) -> Column:
    """The run in the letters of its alphabet."""
    return F.when(k == 16, F.lower(run)).otherwise(F.translate(run, "-_", "+/"))


def squares(run: Column, alphabet: Column, k: Column) -> Column:
    """(sum of squared counts, sum of values, sum of squared values) over the run's characters."""
    counts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.cast("long").alias("v"), (F.length(run) - F.length(F.replace(run, F.substr(alphabet, i + 1, F.lit(1)), F.lit("")))).cast("long").alias("n")))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("nn", "v", "vv")])
    return F.aggregate(counts, zero, lambda a, c: F.struct((a["nn"] + c["n"] * c["n"]).alias("nn"), (a["v"] + c["n"] * c["v"]).alias("v"), (a["vv"] + c["n"] * c["v"] * c["v"]).alias("vv")))


def products(run: Column, alphabet: Column) -> Column:
    """(number of neighbours, sum of their products)."""
    zero = F.struct(F.lit(-1).cast("long").alias("last"), *[F.lit(0).cast("long").alias(c) for c in ("n", "s")])

    def step(a: Column, c: Column) -> Column:
        v = (F.instr(alphabet, c) - 1).cast("long")
        first = a["last"] < 0
        return F.struct(v.alias("last"), F.when(first, a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(first, a["s"]).otherwise(a["s"] + a["last"] * v).alias("s"))

    each = F.transform(F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), lambda p: F.aggregate(F.split(p, ""), zero, step))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(each, none, lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), (a["s"] + e["s"]).alias("s")))


def changes(run: Column, k: Column) -> Column:
    """Neighbours of different classes."""
    lower, upper, rest = ALPHABETS[64][26:52], ALPHABETS[64][:26], ALPHABETS[64][52:]
    classes = F.translate(run, lower + upper + rest, "a" * 26 + "A" * 26 + "0" * 12)
    return F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "a+", "a"), "A+", "A"), "0+", "0")) - 1


def deviations(run: Column) -> tuple[Column, Column]:
    """Of a struct (n, k, sq, pr, ch): the greatest deviation of a test from randomness, and the summed one from the ordinary, towards randomness."""
    n, k = run["n"].cast("double"), run["k"].cast("double")
    mean = run["sq"]["v"] / n
    spread = run["sq"]["vv"] / n - mean * mean
    serial = F.when(spread > 0, (run["pr"]["s"] / F.greatest(run["pr"]["n"], F.lit(1)) - mean * mean) / spread).otherwise(1.0)
    chi = k / n * run["sq"]["nn"] - n
    of = lambda i: by_encoding(run["k"], {e: v[i] for e, v in ORDINARY.items()})
    random_change = by_encoding(run["k"], CHANGES)
    far = lambda x, m, sd: (x - m) / sd
    bernoulli = lambda p: F.sqrt((n - 1) * p * (1 - p))
    excess = n * (k * of(0) - 1)
    random = (far(chi, k - 1, F.sqrt(2 * (k - 1) * (n - 1) / n)), far(run["ch"], (n - 1) * random_change, bernoulli(random_change)), far(serial, -1 / n, 1 / F.sqrt(n)))
    ordinary = (-far(chi, k - 1 + excess * (n - 1) / n, F.sqrt(2 * (k - 1) + 4 * excess)), far(run["ch"], (n - 1) * of(1), bernoulli(of(1))), -far(serial, of(2), 1 / F.sqrt(n)))
    return F.greatest(*[F.abs(x) for x in random]), (ordinary[0] + ordinary[1] + ordinary[2]) / F.sqrt(F.lit(3.0))


def tail_bin(worst: Column, z: Column) -> Column:
    """BINS times -ln of a bound of the tail beyond ``z``, exp(-z^2/2)/2; 0 where the run isn't random."""
    return F.when((worst <= LIMIT) & (z > 0), F.least(F.floor((z * z / 2 + 0.6931471805599453) * BINS), F.lit(LAST_BIN))).otherwise(0).cast("long")


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, runs): for each row its base spans (start, kind, end) in order, and the tested runs (start, end, class, bin)."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for name, pattern, cheap in (("assign", ASSIGN, NAMES + r"""["']?\x20*[:=]"""), ("access", ACCESS, "AKIA"), ("hex", HEX, HEX), ("run", RUN, RUN)):
        df = found(df, "text", name, pattern, cheap)
    df = df.drop("text").withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= LEAST_VALUE))
    span = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    df = df.withColumn("base", F.array_sort(F.concat(*[F.transform(k, span(i)) for i, k in enumerate(KINDS[:3])])))
    # the encoding is that of the run without the signs that fill it up
    df = df.withColumn("run", F.filter(F.transform("run", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(s["hit"], F.lit("=")).alias("hit"))), lambda s: (F.length(s["hit"]) >= LEAST) & encoding(s["hit"]).isNotNull()))
    df = df.withColumn("all", F.when(F.size("run") > 0, F.array_sort(F.concat("base", F.transform("run", span(3))))).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    df = df.withColumn("reach", F.transform("all", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0).cast("long"))))
    df = df.withColumn("next", F.reverse(F.transform("all", lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(FAR)))))
    df = running(running(df, "reach", F.greatest, 0), "next", F.least, FAR)
    # runs keep their order, so that the nth of kind 3 is the nth run
    clear = F.transform(F.filter(F.arrays_zip(F.col("all").alias("s"), F.col("reach").alias("r"), F.reverse("next").alias("x")), lambda z: z["s"]["kind"] == 3), lambda z: (z["r"] <= z["s"]["start"]) & (z["x"] >= z["s"]["end"]))
    df = df.withColumn("run", F.transform(F.filter(F.arrays_zip(F.col("run").alias("s"), clear.alias("c")), lambda z: z["c"]), lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["hit"].alias("hit"), encoding(z["s"]["hit"]).alias("k"))))
    df = df.withColumn("run", F.transform("run", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"), plain(s["hit"], s["k"]).alias("hit"), by_encoding(s["k"], ALPHABETS).alias("abc"))))
    df = df.withColumn("run", F.transform("run", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(s["hit"]).alias("n"), s["k"].alias("k"), squares(s["hit"], s["abc"], s["k"]).alias("sq"), products(s["hit"], s["abc"]).alias("pr"), changes(s["hit"], s["k"]).alias("ch"))))
    tested = F.transform("run", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), length_class(s["n"]).alias("class"), tail_bin(*deviations(s)).alias("bin")))
    return df.select("doc_id", "base", tested.alias("runs"))


def thresholds(rows: DataFrame) -> dict[int, int]:
    """Of each class of lengths the least bin that the step-up takes; a class of which it takes none is missing. LAST_BIN rows a class at most come to the driver."""
    counts = rows.select(F.explode("runs").alias("r")).groupBy(F.col("r.class").alias("class"), F.col("r.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by_class: dict[int, list[tuple[int, int]]] = {}
    for r in counts.collect():
        by_class.setdefault(r["class"], []).append((r.bin, r.n))
    import math

    out = {}
    for c, bins in by_class.items():
        total, so_far = sum(n for _, n in bins), 0
        for b, n in sorted(bins, reverse=True):
            so_far += n
            if math.exp(-b / BINS) <= ALPHA * so_far / total:
                out[c] = b
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of ``docs``.

    ``spans`` lists kind:start:end by start, then kind, in code points, the end
    exclusive; base_sha256 is the digest of the base kinds alone, that of an empty text
    where there are none. Spans of different base kinds may overlap and all stay; random
    ones touch none. A null text counts as empty. Rows that repeat an id or a text are
    scanned each, and each counts for the thresholds. A null id stays null. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = common.written(scanned(docs, id_col, text_col), "spans")
    least = thresholds(rows)
    taken = lambda r: F.coalesce(F.map_from_arrays(F.array(*map(F.lit, least)), F.array(*map(F.lit, least.values())))[r["class"]] <= r["bin"], F.lit(False)) if least else F.lit(False)
    random = F.transform(F.filter("runs", taken), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda spans, i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    both = rows.withColumn("random", random)
    return both.select(
        "doc_id", *[count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.size("random").cast("long").alias("n_random"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
