"""N-gram Jaccard join with Bayesian candidate pruning (operator 2).

Texts are sets of five-word shingles (lower case, words between blanks; fewer words are one shingle).  Exact
copies are one class from the start.  Each class has a MinHash signature; two classes are candidates if they
agree in all values of one of 24 bands.  Candidate pairs compare their signatures a few values at a time and are
dropped once the posterior probability (uniform prior) that the similarity reaches the threshold falls below
``TOLERANCE``; all others are verified exactly on their shingle sets.

Pairs never become rows.  First the signatures of the classes that share a band (bands shared by the same classes
count once) meet in blocks of at most about ``2 * SIEVE`` of them; each block gives a spanning forest of the pairs
that survive the pruning.  The components of these forests, not those of shared bands, are then dealt with their
texts in chunks of at most about ``CHUNK`` classes, each two of which meet in one task, where the pairs are
compared in blocks.  A task returns each class's links as sums and a spanning forest of the links, from which
the groups follow.  So chance agreements of a band move no text and join no components, a group of any size is
spread over tasks of bounded size, and nothing is capped.

Edge cases: null and empty texts (also those of blanks only) have no shingles; they link to their exact copies only.
Rows with a null doc_id take no part and have a null class and no links.  Rows that share a doc_id are judged each by
its own text, as documents of that number.  Repeated rows get the same result each.  Very long texts are taken whole.
Empty tables give empty tables.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, cut, table, text_or_empty, whole_row
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
CHUNK, SIEVE = 256, 1024
#: Word hashes that a worker remembers, and the longest word (characters) whose hash it does.
CACHE, LONGEST = 400_000, 64

_random = np.random.default_rng(20_011)
FACTORS = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MIX, _POLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int = WORDS, most: int = CACHE):
        self.words, self.most, self.known = words, most, {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            fresh = {w: xxhash.xxh64_intdigest(w) for w, x in zip(words, found) if x is None}
            known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
            found = [fresh[w] if x is None else x for w, x in zip(words, found)]
        h, n = np.array(found, np.uint64), min(self.words, len(words))
        out = np.zeros(len(words) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                out = (out + h[j : len(h) - n + 1 + j]) * _POLY
            out ^= out >> np.uint64(31)
            out *= _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values, uint32; of no shingles, all ones."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            part = ((shingles[at : at + 512, None] * FACTORS + OFFSETS) >> np.uint64(32)).astype(np.uint32)
            np.minimum(out, part.min(axis=0), out=out)
    return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """int64 keys of the bands, the band's number being part of the key."""
    x = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
        for j in range(ROWS):
            out = (out + x[:, :, j]) * _POLY
            out ^= out >> np.uint64(32)
        return (out * _MIX).view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE, step: int = STEP, values: int = VALUES) -> list[tuple[int, int]]:
    """(n, m): of n compared values at least m must agree for P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose tail above t is the chance
    of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """d, t1, t2 (hashes of the text), signature, bands of every row with a doc_id."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("d"), text_or_empty().alias("text"))
    rows = rows.select("d", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                sets = [shingler.shingles(t) for t in part.column("text").to_pylist()]
                signs = np.array([signature(s) for s in sets], np.uint32).reshape(len(sets), VALUES)
                keys = bands_of(signs)
                full = np.array([len(s) > 0 for s in sets], bool)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(keys[full].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("d", "t1", "t2")), pa.array([s.tobytes() for s in signs], pa.binary()), bands], ["d", "t1", "t2", "signature", "bands"])

    return rows.mapInArrow(run, "d long, t1 long, t2 long, signature binary, bands array<long>")


def classes_of(sketch: DataFrame) -> DataFrame:
    """node (a number of its own, good once written), id (smallest doc_id), t1, t2, copies, signature, bands of each class of equal texts."""
    same = sketch.groupBy("t1", "t2").agg(F.min("d").alias("id"), F.count("*").alias("copies"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    return same.withColumn("node", F.monotonically_increasing_id())


def meetings(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (node, size of what it belongs to, ...) once for each block of chunks they meet in: adds i, j and side."""
    rows = rows.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    return rows.withColumn("second", F.col("chunk") != F.col("i")).drop("size", "chunks", "chunk", "other")


def shared_bands(classes: DataFrame) -> DataFrame:
    """node, key, size: members of bands that several classes share; of bands with the same members only the least key."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    bands = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead"), *members).where("size > 1")
    bands = cut(bands.groupBy("size", "lead", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "bands")
    return keys.join(bands, "key")


def survivors(signs: np.ndarray, second: np.ndarray, cross: bool, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links (places) of a spanning forest of the pairs that survive the pruning; in a cross block, of pairs from both sides.

    Pairs already connected aren't compared, so a block of near copies takes about as many comparisons as it has classes.
    """
    n, out = len(signs), []
    group = np.arange(n)
    for x in range(n - 1):
        y = x + 1 + np.flatnonzero(group[x + 1 :] != group[x])
        if cross:
            y = y[second[y] != second[x]]
        agree, at = np.zeros(len(y), np.int32), 0
        for upto, least in bounds:
            agree += (signs[y, at:upto] == signs[x, at:upto]).sum(axis=1, dtype=np.int32)
            keep = agree >= least
            y, agree, at = y[keep], agree[keep], upto
        if len(y):
            met, first = np.unique(group[y], return_index=True)
            out += [(x, int(k)) for k in y[first]]
            group[np.isin(group, met)] = group[x]
    return out


def candidate_links(classes: DataFrame, threshold: float, chunk: int = SIEVE) -> DataFrame:
    """a, b: forests, block by block, of the pairs that share a band and survive the pruning."""
    bounds = least_matches(threshold)

    def links(rows: list[tuple], cross: bool) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        signs = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), VALUES)
        return [(rows[a][0], rows[b][0]) for a, b in survivors(signs, np.array([r[1] for r in rows], bool), cross, bounds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, len(batch), 1024)):
                columns = [part.column(c).to_pylist() for c in ("key", "i", "j", "node", "second", "signature")]
                for key, i, j, *row in zip(*columns):
                    if (key, i, j) != at:
                        out += links(rows, at is not None and at[1] != at[2])
                        at, rows = (key, i, j), []
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        out = links(rows, at is not None and at[1] != at[2])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = meetings(shared_bands(classes).join(classes.select("node", "signature"), "node"), chunk)
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return met.select("key", "i", "j", "node", "second", "signature").mapInArrow(run, "a long, b long")


def _dealt(classes: DataFrame, docs: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """A row for each class and each block that it meets in: block key (root, i, j), side, and the class with its text."""
    roots = cut(components(candidate_links(classes, threshold)), "roots")
    nodes = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").join(classes.drop("bands"), "node")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "text")
    nodes = nodes.join(texts, ["id", "t1", "t2"]).dropDuplicates(["node"])
    return meetings(nodes, chunk).select("root", "i", "j", "node", "second", "copies", "signature", "text")


def linked(nodes: np.ndarray, second: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], cross: bool, threshold: float, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the linked pairs in a block; in a cross block, of pairs with one class from each side."""
    n, bands = len(nodes), bands_of(signs)
    share = np.zeros((n, n), bool)
    for b in range(bands.shape[1]):
        share |= bands[:, None, b] == bands[None, :, b]
    share &= nodes[:, None] < nodes[None, :]
    if cross:
        share &= second[:, None] != second[None, :]
    x, y = np.nonzero(share)
    agree, at = np.zeros(len(x), np.int32), 0
    for upto, least in bounds:
        agree += (signs[x, at:upto] == signs[y, at:upto]).sum(axis=1, dtype=np.int32)
        keep = agree >= least
        x, y, agree, at = x[keep], y[keep], agree[keep], upto
    if not len(x):
        return x, y
    sizes = np.array([len(s) for s in sets])
    if len(x) <= 4 * n:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)])
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), sizes)
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        to = np.full(len(count), -1)
        to[often] = np.arange(len(often))
        column = to[place]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        for a in range(0, len(often), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            part = np.zeros((n, min(4096, len(often) - a)), np.float32)
            part[owner[lo:hi], column[lo:hi] - a] = 1
            common += part @ part.T
        both = common[x, y].astype(np.int64)
    ok = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
    return x[ok], y[ok]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of n places."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


FOUND = "node long, peer long, links long, texts long"


def compared(dealt: DataFrame, words: int, threshold: float, pairs: bool) -> DataFrame:
    """``FOUND`` rows: links of a class in a block (peer null), and forest links (or, with ``pairs``, all of them)."""
    bounds = least_matches(threshold)

    def flush(shingler: Shingler, rows: list[tuple]) -> list[tuple]:
        nodes = np.array([r[0] for r in rows], np.int64)
        second, copies = np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows], np.int64)
        signs = np.array([np.frombuffer(r[3], np.uint32) for r in rows])
        if len(rows) < 2:
            return []
        sets = [shingler.shingles(r[4]) for r in rows]
        x, y = linked(nodes, second, signs, sets, rows[0][5], threshold, bounds)
        links = np.bincount(x, copies[y], len(rows)).astype(np.int64) + np.bincount(y, copies[x], len(rows)).astype(np.int64)
        texts = np.bincount(x, minlength=len(rows)) + np.bincount(y, minlength=len(rows))
        out = [(int(nodes[k]), None, int(links[k]), int(texts[k])) for k in np.flatnonzero(texts)]
        kept = zip(x.tolist(), y.tolist()) if pairs else forest(len(rows), x, y)
        return out + [(int(nodes[a]), int(nodes[b]), 0, 0) for a, b in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, key, rows, out = Shingler(words), None, [], []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["node", "peer", "links", "texts"])

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                columns = [part.column(c).to_pylist() for c in ("root", "i", "j", "node", "second", "copies", "signature", "text")]
                for root, i, j, *row in zip(*columns):
                    if (root, i, j) != key:
                        out += flush(shingler, rows)
                        key, rows = (root, i, j), []
                    rows.append((*row, i != j))
                if len(out) > 4096:
                    yield batch_of(out)
                    out = []
        yield batch_of(out + flush(shingler, rows))

    parts = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return parts.mapInArrow(run, FOUND)


def _found(docs: DataFrame, words: int, threshold: float, chunk: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    sketch = cut(sketches(docs, words), "sketches")
    classes = cut(classes_of(sketch), "classes")
    return sketch, classes, cut(compared(_dealt(classes, docs, threshold, chunk), words, threshold, pairs), "links")


def _named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """node, first (id, t1, t2) of the least class of its group: the classes that have links."""
    groups = cut(components(found.where("peer is not null"), "node", "peer").join(classes.select("node", F.struct("id", "t1", "t2").alias("own")), "node"), "groups")
    return groups.join(groups.groupBy("root").agg(F.min("own").alias("first")), "root").select(F.col("node").alias("n"), "first")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """For every row: doc_id, class_id (smallest doc_id of its group), n_links (other documents at least that similar,
    copies included), n_link_texts (different texts among them), n_copies (documents with its text)."""
    sketch, classes, found = _found(docs, words, threshold, chunk, pairs=False)
    sums = found.where("peer is null").groupBy(F.col("node").alias("m")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = classes.select("t1", "t2", "id", "node", "copies").join(_named(classes, found), F.col("node") == F.col("n"), "left").join(sums, F.col("node") == F.col("m"), "left")
    known = cut(known.select("t1", "t2", F.coalesce("first.id", "id").alias("class_id"), "copies", "links", "texts"), "known")
    rows = sketch.select("d", "t1", "t2").join(known, ["t1", "t2"])  # plain shuffles, so many copies can be split
    zero = F.lit(0).cast("long")
    out = rows.select(F.col("d").alias("doc_id"), "class_id", (F.col("copies") - 1 + F.coalesce("links", zero)).alias("n_links"), F.coalesce("texts", zero).alias("n_link_texts"), F.col("copies").alias("n_copies"))
    none = docs.where(F.col("doc_id").isNull()).select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")), *(zero.alias(c) for c in ("n_links", "n_link_texts")), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(none)


def pairs(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """a, b: doc_ids of the linked pairs of class representatives (a <= b), which may be many; their copies are in ``classes_of``."""
    _, classes, found = _found(docs, words, threshold, chunk, pairs=True)
    ids = classes.select("node", "id")
    both = found.where("peer is not null").select("node", "peer").join(ids, "node").withColumnRenamed("id", "x")
    both = both.join(ids.toDF("peer", "y"), "peer")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, columns unchanged; rows without a doc_id stay.

    Should the group have several texts under that doc_id, the one with the smallest hash stays; of rows that repeat, one.
    """
    _, classes, found = _found(docs, words, threshold, chunk, pairs=False)
    own = classes.select("node", "id", "t1", "t2").join(_named(classes, found), F.col("node") == F.col("n"), "left")
    firsts = own.where("first is null or first = struct(id, t1, t2)").select("id", "t1", "t2")
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("t1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("t2"))
    first = Window.partitionBy("id", "t1", "t2").orderBy("t1")
    kept = rows.where("id is not null").join(firsts, ["id", "t1", "t2"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select(f"{ROW}.*").unionByName(rows.where("id is null").select(f"{ROW}.*"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
