"""Secret scans by a randomness test battery (operator 9), in SQL functions only.

Base spans are those of three patterns.  Beside them, every other run of 20 or more characters of an encoding is
a candidate.  Its encoding is inferred from its characters (decimal, hex, one-case letters, base32, letters and
digits, base64).  Three tests ask whether it is random in that alphabet: chi-squared uniformity, number of runs
above and below the alphabet's middle, and serial correlation; Fisher's method joins them.  A fourth number asks
how likely ordinary text would be such a run: by its letter pairs and changes between kinds of characters, against
equally likely ones (an inverse likelihood ratio bounds the chance; pairs that repeat more than chance would have it
count once), and for letters with digits also by how uniform
it is.  Benjamini-Hochberg over all candidates of a length class turns it into a bound, so the false-discovery rate holds at each length, short ones with little power
included.  A candidate is a secret if it passes both.  Runs of digits alone can't be told from ordinary numbers: they
are neither reported nor counted.  Bounds come from counts in fixed bins (at most
LENGTH_CLASSES x BINS rows); no candidate travels.

Edge cases: a null text is the empty one; empty texts have no spans (digest of the empty string).  Positions are
code points, ends exclusive.  Texts are scanned whole, however long.  Repeated rows are scanned each.  An empty table
gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, table, text_or_empty

#: Kinds in order, their patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Inferred encodings in order, their characters, alphabet size, and in ordinary text the chance
#: that two and that three characters are the same.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10, 0.18, 0.045),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, 0.13, 0.022),
    ("letters", r"^([a-z]+|[A-Z]+)$", 26, 0.068, 0.0056),
    ("base32", r"^[A-Z2-7=]+$", 32, 0.066, 0.0053),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 62, 0.062, 0.0048),
    ("base64", r"^.+$", 64, 0.060, 0.0046),
)
#: False-discovery rate within a length class, and the least joint p-value of the three randomness tests.
RATE, LEAST_P = 0.01, 0.001
LENGTH_CLASSES, BINS, PER_DECADE = 24, 65, 4
#: Half bits (a = 0) of a letter after a letter in ordinary text, of pairs aa, ab, ... zz; counted over the
#: Python library's sources and documents in four languages, a tenth of the weight dealt evenly.
PAIRS = [ord(c) - 97 for c in (
    "mljklpmojpoijfmmphhfinoonqjpmoeqppkiqeppioqllpiqqqipjqopipqdgqkjopgpqmnimpqqpqimoldpqlgpqlqlgpqljjkqnpoqinkiklonjqphmgmmofhinnnkoo"
    "hmnnhknmgqokpnenqgkikopqoohmoqdqnjiqpjojjoqkgkjnnqqofmpqdqplhqpmolhpqlljnpnqppmnjmhjmpoqpkkdgnplhhqmpoqncqmqeqqqoqnqqqhoqqopiqqqpq"
    "lqonbpnqjqqkplnnpnjompjqpqhpomdhpqhqqhppjoqpkllppqgqhlpocqqqgqqompiiqplomqqqpqimjggnhlkqnlolhnpmifmmnqopnlljoioqlqomkenkqfjjgompqq"
    "dqoohfqplqpjpphkqinjmopqlqppqpqqqqpqqoqnopplnpaqqqqqhmmndokliqnmmihopjjimonqmpkoiofpngippmnnklomjekpoqnqionogopdfqpnonioqikljpnqlm"
    "klmoflnnkqpijglkogjiooohqpfqpqcpqpeqqqopipqpqqqqpqqqgppnipqdfqqnqljpqimpqqopqqhogpgoqpiqqkkqiiljnfqlqnopjlnogopjiqqkliigqlggppkqpp"
    "jmmpdqnmipnlmolopnmmdoqqpn"
)]
#: Chances of a lower-case letter, upper-case letter, digit and sign in ordinary runs after one of each.
CHANGES = ((0.78, 0.10, 0.04, 0.08), (0.20, 0.70, 0.05, 0.05), (0.15, 0.10, 0.60, 0.15), (0.50, 0.20, 0.20, 0.10))
#: Half bits of a letter not looked at as a pair, of a digit and of a sign, equally likely ones.
LETTER, DIGIT, SIGN = 9, 7, 5


def matched(text: Column, kind: str, pattern: str, group: int) -> dict[str, Column]:
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return {f"m_{kind}": whole} | ({f"g_{kind}": F.regexp_extract_all(text, F.lit(pattern), F.lit(group))} if group else {})


def located(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, stop>> of the matches that are long enough; the text between matches gives positions."""
    found, sized = F.col(f"m_{kind}"), F.col(f"g_{kind}" if group else f"m_{kind}")
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), sized.alias("sized"))
    lengths = F.transform(F.slice(rows, F.lit(1), F.size(found)), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["sized"]).alias("sized")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    start = lambda acc, x: acc["at"] + x["gap"]
    step = lambda acc, x: F.struct(
        (start(acc, x) + x["hit"]).alias("at"),
        F.when(x["sized"] >= least, F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), (start(acc, x) + x["hit"]).alias("stop"))))).otherwise(acc["out"]).alias("out"),
    )
    return F.when(F.exists(sized, lambda x: F.length(x) >= least), F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def normal(z: Column) -> Column:
    """The normal distribution function, to about four decimals in the middle and in proportion in the tails."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _by_encoding(token: Column, value: int) -> Column:
    out = F.lit(ENCODINGS[-1][value])
    for row in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(row[1]), F.lit(row[value])).otherwise(out)
    return out


def _cost(last: Column, kind0: Column, c: Column, kind: Column) -> Column:
    """Half bits of a character after another one in ordinary text."""
    changes = F.array(*(F.lit(round(-2 * log2(x))) for row in CHANGES for x in row))
    pair = F.get(F.array(*(F.lit(x) for x in PAIRS)), (last.bitwiseAND(31) - 1) * 26 + c.bitwiseAND(31) - 1)
    own = F.when(kind == 2, DIGIT).when(kind == 3, SIGN).when((kind0 < 2) & (kind <= kind0), pair).when((kind0 == 1) & (kind == 0), pair).otherwise(LETTER)
    return F.get(changes, kind0 * 4 + kind) + own


def _kind(c: Column) -> Column:
    return F.when(c >= 97, 0).when((c >= 65) & (c <= 90), 1).when((c >= 48) & (c <= 57), 2).otherwise(3)


def measured(token: Column, span: Column) -> Column:
    """What the tests need of a token: length, alphabet, sum of squared counts, runs, moments of the code points."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))
    order = F.array_sort(codes)
    zero = F.lit(0).cast("long")
    squares = F.aggregate(
        order,
        F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("sum")),
        lambda a, c: F.struct(c.alias("last"), F.when(c == a["last"], a["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), (a["sum"] + F.when(c == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("sum")),
        lambda a: a["sum"],
    )
    middle = F.element_at(order, F.greatest(F.floor(F.size(order) / 2), F.lit(1)).cast("int"))
    walk = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), zero.alias("runs"), zero.alias("high"), zero.alias("s1"), zero.alias("s2"), zero.alias("lag"), F.lit(0).alias("first"), middle.alias("middle"), zero.alias("cost")),
        lambda a, c: F.struct(
            c.alias("last"),
            (a["runs"] + F.when((a["last"] < 0) | ((c > a["middle"]) != (a["last"] > a["middle"])), 1).otherwise(0)).alias("runs"),
            (a["high"] + F.when(c > a["middle"], 1).otherwise(0)).alias("high"),
            (a["s1"] + c).alias("s1"),
            (a["s2"] + c * c).alias("s2"),
            (a["lag"] + F.when(a["last"] < 0, 0).otherwise(c * a["last"])).alias("lag"),
            F.when(a["last"] < 0, c).otherwise(a["first"]).alias("first"),
            a["middle"].alias("middle"),
            (a["cost"] + F.when(a["last"] < 0, 0).otherwise(_cost(a["last"], _kind(a["last"]), c, _kind(c)))).alias("cost"),
        ),
    )
    pairs = let(codes, lambda cs: F.size(F.array_distinct(F.transform(cs, lambda c, i: c * 256 + F.coalesce(F.get(cs, i + 1), F.lit(0))))) - 1)
    return F.struct(
        pairs.cast("double").alias("pairs"), span["start"].alias("start"), span["stop"].alias("stop"), F.length(token).cast("double").alias("n"),
        _by_encoding(token, 2).cast("double").alias("m"), _by_encoding(token, 3).alias("k2"), _by_encoding(token, 4).alias("k3"),
        (token.rlike("[0-9]") & token.rlike("[A-Za-z]")).alias("mixed"), squares.cast("double").alias("squares"), walk.alias("walk"),
    )


def tested(x: Column, least_p: float = LEAST_P) -> Column:
    """start, stop, length class, joint p-value of the randomness tests, p-value of ordinary text."""
    n, m, w = x["n"], x["m"], x["walk"]
    chi = m / n * x["squares"] - n
    p_chi = 1 - normal((chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n))
    high, low = w["high"].cast("double"), n - w["high"]
    both = 2 * high * low
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(spread > 0, (w["runs"] - both / n - 1) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(F.lit(8.0))
    mean = w["s1"] / n
    variance = w["s2"] - n * mean * mean
    lagged = w["lag"] - mean * (2 * w["s1"] - w["first"] - w["last"]) + (n - 1) * mean * mean
    z_serial = F.when(variance > 0, (lagged / F.when(variance > 0, variance).otherwise(1.0) + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
    two = lambda z: 2 * (1 - normal(F.abs(z)))
    least = lambda p: F.greatest(p, F.lit(1e-12))
    half = -(F.log(least(p_chi)) + F.log(least(two(z_runs))) + F.log(least(two(z_serial))))
    joint = F.exp(-half) * (1 + half + half * half / 2)
    k2, k3 = x["k2"], x["k3"]
    pairs = n * (n - 1) / 2 * (k2 - k2 * k2) + n * (n - 1) * (n - 2) * (k3 - k2 * k2)
    ordinary = normal((chi - (m * (1 + (n - 1) * k2) - n)) / (m / n * 2 * F.sqrt(pairs)))
    # The encoding is chosen from the characters, so each of them may have been tried.
    # A name that repeats a word repeats its pairs; more repeats than chance makes in the alphabet tell nothing new.
    chance = n - 1 - m * m * (1 - F.pow(1 - 1 / (m * m), n - 1))
    again = F.greatest(n - 1 - x["pairs"] - chance, F.lit(0.0))
    gain = w["cost"] / 2 * (1 - again / (n - 1)) - (n - 1) * F.log2(m)
    unlikely = F.least(F.lit(1.0), len(ENCODINGS) * F.pow(F.lit(2.0), -F.least(F.greatest(gain, F.lit(0.0)), F.lit(80.0))))
    # Without both letters and digits a uniform run is as likely as not a word; there the likelihood decides alone.
    either = F.least(F.lit(1.0), F.when(x["mixed"], 2 * F.least(ordinary, unlikely)).otherwise(unlikely))
    # A run that fails the randomness tests is no discovery and must not help others to be one; digits alone don't count.
    p = F.when(m == 10, F.lit(None).cast("double")).when(joint >= least_p, either).otherwise(F.lit(1.0))
    size_class = F.least(F.floor(F.log2(n)), F.lit(LENGTH_CLASSES - 1)).cast("int")
    bin_ = F.when(p.isNotNull(), F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-17))) * PER_DECADE), F.lit(BINS - 1)).cast("int"))
    return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), size_class.alias("class"), joint.alias("random_p"), p.alias("ordinary_p"), bin_.alias("bin"))


def scanned(docs: DataFrame, least_p: float = LEAST_P) -> DataFrame:
    """doc_id, the base spans of each kind, and the tested candidates of every row."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hits: dict[str, Column] = {}
    for kind, pattern, group, _ in BASE:
        hits |= matched(text, kind, pattern, group)
    rows = rows.select("doc_id", "text", *(c.alias(k) for k, c in hits.items()), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m_candidate"))
    rows = rows.select("doc_id", *(located(text, *b).alias(b[0]) for b in BASE), located(text, "candidate", CANDIDATE, 0, 20).alias("found"), "m_candidate")
    free = lambda c: ~F.exists(F.concat(*(F.col(b[0]) for b in BASE)), lambda s: (s["start"] < c["span"]["stop"]) & (s["stop"] > c["span"]["start"]))
    pairs = F.filter(F.arrays_zip(F.col("m_candidate").alias("token"), F.col("found").alias("span")), free)
    rows = rows.withColumn("stats", F.transform(pairs, lambda c: measured(c["token"], c["span"])))
    return rows.select("doc_id", *(b[0] for b in BASE), F.transform("stats", lambda x: tested(x, least_p)).alias("candidates"))


def bounds(scan: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length class the first bin whose candidates are discoveries (Benjamini-Hochberg over bins)."""
    bins = scan.select(F.explode("candidates").alias("c")).where("c.bin is not null").groupBy(F.col("c.class").alias("class"), F.col("c.bin").alias("bin")).count()
    upto = Window.partitionBy("class").orderBy(F.desc("bin"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE)
    ok = bins.withColumns({"so_far": F.sum("count").over(upto), "all": F.sum("count").over(Window.partitionBy("class"))}).where(edge * F.col("all") <= rate * F.col("so_far"))
    return {r["class"]: r["bin"] for r in ok.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rate: float = RATE, least_p: float = LEAST_P) -> DataFrame:
    """doc_id and spans array<struct<start, kind, stop>> of every row, ordered; base kinds, and ``random`` for the battery's."""
    rows = cut(scanned(docs, least_p), "secrets")
    first = bounds(rows, rate)
    bound = F.create_map(*(F.lit(x) for kv in (first or {-1: BINS}).items() for x in kv))
    of_class = lambda c: F.coalesce(F.try_element_at(bound, c), F.lit(BINS))
    random = F.filter("candidates", lambda c: (c["bin"] >= of_class(c["class"])) & (c["random_p"] >= least_p))
    kinds = [*(b[0] for b in BASE), "random"]
    named = [_named(random if k == "random" else F.col(k), i, k) for i, k in enumerate(kinds)]
    return rows.select("doc_id", F.array_sort(F.concat(*named)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return rows.select("doc_id", *(count(b[0]) for b in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
