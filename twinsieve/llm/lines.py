"""Line dedup by winnowing over line hashes (operator 4), in SQL functions only.

A text's lines are cut at line ends, after sentences and, so that a passage within a long line is seen too, by content:
after each word that ends in d, l or u, the same words wherever the passage begins (texts without blanks, such as
Chinese ones, after their punctuation marks).  Lines are hashed in lower case, without blanks around.  Of every ``window`` consecutive hashes of ``gram`` lines the smallest is a fingerprint, so any repeated run of
window + gram - 1 lines has one in common with its other place; a line of
``least_chars`` characters is always one.  Each fingerprint's places are joined to its first
place in order of (doc_id, text hash, line), never to each other, and a match is extended both ways while lines are
equal.  It need not look farther than window - 1 lines: there the run's next fingerprint is due, which has a match of
its own.  As the window is no longer than the gram, the fingerprints of a run leave no line between them; so of a
repeated run everything is found but at most window - 1 lines at an end, where the last fingerprint's first place is
another text that goes on otherwise.  Stretches of repeats of at least ``least_chars`` characters are deleted.  The first
place of a fingerprint is never deleted on its account, so one copy of each passage stays.

Places in other texts are never visited for that: the hashes (32 bits) of the lines around travel with a fingerprint.

Edge cases: a null text is the empty one; an empty text stays.  A null doc_id comes first.  Rows that repeat both
doc_id and text are one document: they aren't deleted against each other and each gets the same result.  Texts
without repeats are returned as they are, character by character.  Texts are taken whole, however long; repeats within
one text count, too.  An empty table gives an empty result.  Other columns are kept and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, let, table, text_or_empty, whole_row

#: What a line may end with before a blank: ends of sentences, and letters that end about one word in eight in several languages.
ENDS = ".!?dlu"
#: What lines end after in texts without blanks.
MARKS = "\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a"
#: Lines of a gram, grams of a window, characters of a stretch that is deleted and of a line that is always a fingerprint.
GRAM, WINDOW, LEAST_CHARS = 3, 3, 100
NO_ID = -(1 << 63)
#: Bits of a place that tell the line; ids of fewer than 63 - LINE_BITS bits and a line fit into one number.
LINE_BITS = 27


def _cut(text: Column, wide: Column) -> Column:
    """The lines in lower case, without the blank or line end after each (with it, if ``wide``), by plain replacement: cutting at a single character is fast."""
    bare = F.replace(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i"))), F.lit("\t"), F.lit(" "))
    marked = bare
    for end in ENDS:
        marked = F.replace(marked, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.when(wide, F.split(bare, rf"(?<=[{MARKS}\n])")).otherwise(F.split(marked, "\n"))


def _odd(h: Column) -> Column:
    return h.bitwiseAND(F.lit(1)) == 1


def line_hashes(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """array<struct<x, l, n>>: the 32-bit hash of each line; an odd 64-bit one of those of enough characters, else null; its characters."""
    # Most characters take three bytes or more in scripts that mostly do without blanks.
    wide = F.octet_length(text) > 2 * F.length(text)
    row = lambda x, n: F.struct(F.hash(x).alias("x"), F.when(n >= least_chars, F.xxhash64(x).bitwiseOR(F.lit(1))).alias("l"), n.alias("n"))
    of = lambda lines, after: F.transform(lines, lambda x, i: row(F.trim(x), F.length(x) + F.when(i < F.size(lines) - 1, after).otherwise(0)))
    return let(wide, lambda w: let(_cut(text, w), lambda lines: of(lines, F.when(w, 0).otherwise(1))))


def lines_of(text: Column) -> Column:
    """The lines themselves, array<string>; joined they are the text."""
    ends = lambda xs: F.aggregate(xs, F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")), lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"], x["n"]))).alias("out")), lambda s: s["out"])
    return ends(line_hashes(text))


def _key(docs: DataFrame, unique: bool) -> list[Column]:
    """d, h: what tells documents apart; h is the text's hash, or 0 where doc_id does it alone (fewer bytes to move)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), (F.lit(0).cast("long") if unique else F.xxhash64(text_or_empty())).alias("h")]


def ids_of(docs: DataFrame) -> tuple[bool, bool]:
    """Whether ids don't repeat, and whether they are small enough to share a number with a line."""
    ids = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d")).count()
    most, low, high = ids.agg(F.max("count"), F.min("d"), F.max("d")).first()
    return (most or 1) == 1, (low or 0) >= 0 and (high or 0) < 1 << 63 - LINE_BITS


def hashed_lines(docs: DataFrame, unique: bool, least_chars: int) -> tuple[DataFrame, int]:
    """d, h, lines as ``line_hashes`` returns them: a row for each distinct (doc_id, text); and the most lines of a text."""
    rows = docs.select(*_key(docs, unique), line_hashes(text_or_empty(), least_chars).alias("lines"))
    seen = Observation()
    rows = rows if unique else rows.groupBy("d", "h").agg(F.any_value("lines").alias("lines"))
    rows = cut(rows.observe(seen, F.max(F.size("lines")).alias("most")), "lines")
    return rows, seen.get["most"] or 0


def winnowed(lines: DataFrame, gram: int, window: int, packed: bool, around: bool = True) -> DataFrame:
    """f, place, near, far: fingerprints, the rightmost of equal minima (even) and long lines (odd), and where they are.

    A place is the struct (d, h, line), or one number in the same order.  With ``around``, ``near`` and ``far`` hold the
    hashes of the lines next and next but one to the fingerprint's, the earlier in the high bits; where there is none,
    the document's own.
    """
    most, half = (1 << LINE_BITS) - 1, (1 << 32) - 1

    def found(hs: Column, p: Column, f: Column, size: int) -> Column:
        hash_of = lambda at, side: F.coalesce(F.get(hs, at), F.hash("d", "h", F.lit(side))).cast("long")
        both = lambda n: F.shiftleft(hash_of(p - n, -n), 32).bitwiseOR(hash_of(p + size - 1 + n, n).bitwiseAND(F.lit(half)))
        return F.struct(p.alias("line"), f.alias("f"), *([both(1).alias("near"), both(2).alias("far")] if around else []))

    # All arrays are bound by ``let``: a column's expression would be worked out anew for each element.
    gram_at = lambda hs, x, i: F.xxhash64(x, *(F.get(hs, i + j) for j in range(1, gram)))
    # The gram's number in the low bits tells minima apart and finds them again.
    keyed = lambda hs: F.transform(F.slice(hs, F.lit(1), F.greatest(F.size(hs) - (gram - 1), F.lit(0))), lambda x, i: gram_at(hs, x, i).bitwiseAND(F.lit(~most)).bitwiseOR((F.lit(most) - i).cast("long")))
    least = lambda ks: F.array_distinct(F.transform(F.slice(ks, F.lit(1), F.greatest(F.size(ks) - (window - 1), F.least(F.size(ks), F.lit(1)))), lambda k, i: F.array_min(F.slice(ks, i + 1, F.lit(window)))))
    at = lambda hs, p: found(hs, p, gram_at(hs, F.get(hs, p), p).bitwiseAND(F.lit(-2)), gram)
    minima = lambda hs: F.transform(let(keyed(hs), least), lambda k: let((F.lit(most) - k.bitwiseAND(F.lit(most))).cast("int"), lambda p: at(hs, p)))
    alone = lambda hs: F.transform(F.filter(F.transform("lines.l", lambda f, p: F.struct(f.alias("f"), p.alias("p"))), lambda x: x["f"].isNotNull()), lambda x: found(hs, x["p"], x["f"], 1))
    rows = lines.select("d", "h", F.explode(let(F.col("lines.x"), lambda hs: F.concat(minima(hs), alone(hs)))).alias("p"))
    place = F.shiftleft("d", LINE_BITS).bitwiseOR(F.col("p.line").cast("long")) if packed else F.struct("d", "h", F.col("p.line").alias("line"))
    return rows.select(F.col("p.f").alias("f"), place.alias("place"), *(F.col(f"p.{c}").alias(c) for c in ("near", "far") if around))


SPANS = "array<struct<a:int,b:int>>"


def _merged() -> Column:
    """What sorted ``runs`` cover, in stretches of consecutive lines."""
    done = lambda s: F.when(s["a"] >= 0, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        joins = (s["a"] >= 0) & (x["a"] <= s["b"] + 1)
        return F.struct(
            F.when(joins, s["a"]).otherwise(x["a"]).alias("a"),
            F.when(joins, F.greatest(s["b"], x["b"])).otherwise(x["b"]).alias("b"),
            F.when(joins, s["out"]).otherwise(done(s)).alias("out"),
        )

    return F.aggregate("runs", F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(SPANS).alias("out")), step, done)


def _sized(least_chars: int) -> Column:
    """Of ``spans`` those of enough characters, array<struct<a, b, from, to>>, with the characters before and at their ends."""
    chars = lambda first, n: F.aggregate(F.slice("sizes", first + 1, n), F.lit(0), lambda m, x: m + x)
    wider = "array<struct<a:int,b:int,from:int,to:int>>"

    def step(s: Column, g: Column) -> Column:
        start = s["at"] + chars(s["next"], g["a"] - s["next"])
        return let(F.struct(start.alias("from"), (start + chars(g["a"], g["b"] - g["a"] + 1)).alias("to")), lambda x: F.struct(
            (g["b"] + 1).alias("next"), x["to"].alias("at"),
            F.when(x["to"] - x["from"] >= least_chars, F.concat(s["out"], F.array(F.struct(g["a"].alias("a"), g["b"].alias("b"), x["from"].alias("from"), x["to"].alias("to"))))).otherwise(s["out"]).alias("out"),
        ))

    return F.aggregate("spans", F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), F.array().cast(wider).alias("out")), step, lambda s: s["out"])


def repeats(docs: DataFrame, unique: bool, small: bool, gram: int = GRAM, window: int = WINDOW, least_chars: int = LEAST_CHARS) -> DataFrame:
    """d, h, gone array<struct<a, b, from, to>>: first and last line of each stretch of lines that are later repeats, and its characters."""
    if not 1 <= window <= min(gram, 3):
        raise ValueError("the window must be at most the gram, and 3")
    lines, most = hashed_lines(docs, unique, least_chars)
    packed = unique and small and most < 1 << LINE_BITS
    prints = winnowed(lines, gram, window, packed)
    firsts = winnowed(lines, gram, window, packed, around=False).groupBy("f").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that joins read two plain shuffles and the places of a very common fingerprint can be split.
    same = cut(prints.join(cut(firsts, "firsts"), "f"), "same")
    first = same.where("place = first").select("f", F.col("near").alias("near0"), F.col("far").alias("far0"))
    hits = same.where("place > first").join(first, "f")
    differ = {n: F.col(n).bitwiseXOR(F.col(f"{n}0")) for n in ("near", "far")}
    before = lambda n: F.shiftrightunsigned(differ[n], 32) == 0
    behind = lambda n: differ[n].bitwiseAND(F.lit((1 << 32) - 1)) == 0
    reach = lambda side: F.when(~side("near") | F.lit(window < 2), 0).when(~side("far") | F.lit(window < 3), 1).otherwise(2)
    line = F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int") if packed else F.col("place.line")
    d, h = (F.shiftright("place", LINE_BITS), F.lit(0).cast("long")) if packed else (F.col("place.d"), F.col("place.h"))
    runs = hits.select(d.alias("d"), h.alias("h"), F.struct((line - reach(before)).alias("a"), (line + F.when(_odd(F.col("f")), 0).otherwise(gram - 1) + reach(behind)).alias("b")).alias("run"))
    spans = runs.groupBy("d", "h").agg(F.sort_array(F.collect_list("run")).alias("runs")).select("d", "h", _merged().alias("spans"))
    spans = spans.join(lines.select("d", "h", F.col("lines.n").alias("sizes")), ["d", "h"])
    return spans.select("d", "h", _sized(least_chars).alias("gone")).where(F.size("gone") > 0)


def dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Each row of ``docs`` (a struct of all but text), ``gone`` (the deleted stretches, null without any), and the text that is left."""
    unique, small = ids_of(docs)
    found = repeats(docs, unique, small, gram, window, least_chars)
    rows = docs.select(whole_row(docs, but=["text"]), *_key(docs, unique), docs["text"].cast("string").alias("text")).join(found, ["d", "h"], "left")
    # What is left lies before the first stretch, between each two, and after the last.
    after = lambda k: F.coalesce(F.get("gone", k - 1)["to"], F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.substring("text", after(k) + 1, F.coalesce(F.get("gone", k)["from"], F.length("text")) - after(k)))
    return rows.select(ROW, "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(parts, "")).alias("left"))


def without_repeats(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with later repeats deleted from text (and n_chars to match); documents that are nothing but repeats go."""
    rows = dedup(docs, **how)
    changed = F.col("gone").isNotNull()
    values = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("left").cast("long")).otherwise(F.col(f"{ROW}.n_chars"))
    out = [(values[c] if c in values else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns]
    return rows.where(~changed | (F.trim("left") != "")).select(*out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(table(spark, sf_dir, "documents"))
    spans = F.coalesce(F.array_join(F.transform("gone", lambda g: F.concat_ws(":", g["a"].cast("string"), (g["b"] + 1).cast("string"))), ","), F.lit(""))
    deleted = F.coalesce(F.aggregate("gone", F.lit(0), lambda s, g: s + g["b"] - g["a"] + 1), F.lit(0))
    return rows.select(F.col(f"{ROW}.doc_id").alias("doc_id"), deleted.cast("long").alias("n_deleted"), spans.alias("deleted_lines"), F.length("left").cast("long").alias("n_chars_left"), F.sha2(F.col("left").cast("binary"), 256).alias("text_sha256"))
