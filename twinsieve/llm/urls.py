"""URL filtering with a sorted digest array (operator 5).

The rules' keys (host + path) are hashed with 64-bit xxhash and sorted; the array, the offsets and the stored
key strings lie in one binary that each Python worker memory-maps.  A url's candidate keys are its host and
parent domains, each with every prefix of its path that is as long as some rule's path; they are probed with a
vectorised binary search and confirmed against the stored strings, so a digest collision can't decide.  Urls of a
batch that agree in host and in as much of the path as any rule has are looked up once.  The list of blocked hosts
is a parameter; ``read_hosts`` reads one from a file.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed.  Repeated
urls are judged each.  An empty table gives an empty result.  Other columns are not looked at.  The longest
fitting rule wins; of two as long, the one with the longer host; of the same rule given twice, the first.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, once, table

#: Bytes of index that may be broadcast; ``judge`` refuses a longer list, ``judge_by_join`` takes it.
MAX_INDEX_BYTES = 256 << 20

#: The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)


def read_hosts(path: str) -> list[str]:
    """The hosts of a list: one a line, the last word counts (lines of a hosts file), ``#`` begins a comment; A-Z lower-cased."""
    with open(path, encoding="utf-8") as f:
        words = [line.split("#")[0].split() for line in f]
    return list(dict.fromkeys(w[-1].lower().strip(".") for w in words if w))


def build_index(rules: Iterable[tuple[str, str, str]], seed: int = 0) -> bytes:
    """One binary: counts, path lengths, sorted digests, string offsets, host lengths, verdicts, key strings."""
    unique: dict[str, tuple[str, str]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        unique.setdefault(host + path, (host, verdict))
    rows = sorted((xxhash.xxh64_intdigest(k.encode(), seed), k.encode(), len(h.encode()), v == "block") for k, (h, v) in unique.items())
    lengths = sorted({len(k) - h for _, k, h, _ in rows})
    blob = b"".join(k for _, k, _, _ in rows)
    offsets = np.cumsum([0, *(len(k) for _, k, _, _ in rows)], dtype=np.uint64)
    return b"".join([
        np.array([len(rows), len(lengths), seed], np.uint64).tobytes(),
        np.array(lengths, np.uint64).tobytes(),
        np.array([r[0] for r in rows], np.uint64).tobytes(),
        offsets.tobytes(),
        np.array([r[2] for r in rows], np.uint64).tobytes(),
        np.array([r[3] for r in rows], np.uint64).tobytes(),
        blob,
    ])


class DigestArray:
    """The binary of ``build_index``, memory-mapped from a file that is unlinked once it is open."""

    def __init__(self, raw: bytes):
        fd, path = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "w+b") as f:
                f.write(raw)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)
        words = np.frombuffer(self.map, np.uint64, count=len(raw) // 8)
        n, m, seed = (int(x) for x in words[:3])
        self.seed, at = seed, 3
        self.lengths = [int(x) for x in words[at : at + m]]
        at += m
        self.digests, at = words[at : at + n], at + n
        self.offsets, at = words[at : at + n + 1], at + n + 1
        self.hosts, at = words[at : at + n], at + n
        self.blocks, at = words[at : at + n], at + n
        self.start = at * 8

    def key(self, i: int) -> bytes:
        return self.map[self.start + int(self.offsets[i]) : self.start + int(self.offsets[i + 1])]

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """The place of each key in the array, -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        hit = self.digests[np.minimum(at, len(self.digests) - 1)] == digests
        for j in np.flatnonzero(hit):
            i = int(at[j])
            while i < len(self.digests) and self.digests[i] == digests[j]:
                if self.key(i) == keys[j]:
                    out[j] = i
                    break
                i += 1
        return out


def candidates(host: bytes, path: bytes, lengths: Sequence[int]) -> Iterator[tuple[bytes, int]]:
    """Keys that a rule for this url may have, and the length of their host part."""
    at = 0
    while host:
        part = host[at:]
        for n in lengths:
            if n > len(path):
                break
            yield part + path[:n], len(part)
        at = host.find(b".", at) + 1
        if not at:
            break


def split_url(urls: DataFrame) -> DataFrame:
    """page_id, url's host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.select(F.col("page_id").cast("long").alias("page_id"), F.translate(host, upper, lower).alias("host"), path.alias("path"))


def best(array: DigestArray, hosts: Sequence[str], paths: Sequence[str]) -> list[int]:
    """The place of the longest fitting rule of each url, -1 without one."""
    longest = max(array.lengths, default=0)
    different: dict[tuple[bytes, bytes], int] = {}
    which = [different.setdefault((h.encode(), p[:longest].encode()[:longest]), len(different)) for h, p in zip(hosts, paths)]
    keys, owners, ranks = [], [], []
    for (h, p), i in different.items():
        for key, n in candidates(h, p, array.lengths):
            keys.append(key)
            owners.append(i)
            ranks.append((len(key), n))
    out, top = [-1] * len(different), [(-1, -1)] * len(different)
    for j, at in enumerate(array.find(keys)):
        # The same key may be cut into host and path in two ways; only the rule's own cut fits.
        if at >= 0 and int(array.hosts[at]) == ranks[j][1] and ranks[j] > top[owners[j]]:
            out[owners[j]], top[owners[j]] = int(at), ranks[j]
    return [out[i] for i in which]


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, blocked_hosts: Iterable[str] = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by (rule, blocklist or default)."""
    first, second = build_index(rules), build_index(("block", h, "") for h in blocked_hosts)
    if len(first) + len(second) > MAX_INDEX_BYTES:
        raise ValueError(f"the index is longer than {MAX_INDEX_BYTES} bytes; use judge_by_join")
    shared = urls.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, blocked = once(shared, lambda value: [DigestArray(raw) for raw in value])
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            by_rule, by_list = best(ruled, hosts, paths), best(blocked, hosts, [""] * len(hosts))
            names = [ruled.key(i).decode() if i >= 0 else None for i in by_rule]
            verdicts = ["block" if (ruled.blocks[i] if i >= 0 else j >= 0) else "allow" for i, j in zip(by_rule, by_list)]
            by = ["rule" if i >= 0 else "blocklist" if j >= 0 else "default" for i, j in zip(by_rule, by_list)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts), pa.array(by)], ["page_id", "host", "path", "rule", "verdict", "decided_by"])

    return split_url(urls).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, decided_by string")


def judge_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``judge`` by a DataFrame of rules (verdict, host, path) of any length: candidate keys are joined by digest."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict")).withColumnsRenamed({"host": "rule_host", "path": "rule_path"})
    rules = rules.withColumn("digest", F.xxhash64("rule_host", "rule_path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    split = cut(split_url(urls).withColumn("key", F.monotonically_increasing_id()), "urls")
    keys = split.where("host <> ''").select("key", F.explode(parents).alias("h"), prefixes.alias("ps")).select("key", "h", F.explode("ps").alias("p")).withColumn("digest", F.xxhash64("h", "p"))
    fits = keys.join(rules, "digest").where("h = rule_host and p = rule_path")
    top = fits.groupBy("key").agg(F.max(F.struct(F.octet_length(F.concat("h", "p")).alias("n"), F.octet_length("h").alias("m"), F.concat("h", "p").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("top"))
    out = split.join(top, "key", "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, t) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b(n) AS (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')),
f AS (SELECT p.page_id, max_by(r.h || r.t, len(r.h || r.t)) AS rule, max_by(r.v, len(r.h || r.t)) AS v
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t) GROUP BY p.page_id),
l AS (SELECT DISTINCT p.page_id FROM p JOIN b ON regexp_matches(p.host, '(^|[.])' || b.n || '[.]example[.](com|net|org)$'))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN l.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.v IS NOT NULL THEN 'rule' WHEN l.page_id IS NOT NULL THEN 'blocklist' ELSE 'default' END AS decided_by
FROM p LEFT JOIN f USING (page_id) LEFT JOIN l USING (page_id)
"""
