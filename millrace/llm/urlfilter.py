"""URL filters: a blocked Bloom filter passes possible hits on to an exact hash join.

There are two lists. *Rules* are places as they are written in URLs, host and path prefix ("example.net/en/"):
a rule fits its host, all subdomains and every path that starts with its own. *Listed* URLs are made
canonical, as each page's URL is for them (see ``canonical``): one that ends in "/" covers its host, all
subdomains and all below its path, any other just the page it names.

1. Keys of both lists go into the filter. It is split in blocks of 256 bits; a key's bits lie in one block,
   so a look-up touches one cache line. It takes BITS_EACH bits for each key up to MAX_BYTES in all: that
   bounds what is broadcast, a longer list only lets more through to the join, and the result is the same.
2. Each URL is taken apart once. What of it could be listed, host suffixes with no more labels than the
   longest entry has and path prefixes with no more folders, is looked up in the filter.
3. The distinct keys that pass are joined with the lists by their text, in a shuffled hash join, which
   removes false positives. A key that many pages share is one row there.
4. What is left goes back to the rows. A rule decides before a listed URL, and among rules the longest (of
   equal lengths the one with the longer host), among listed URLs a block before an allow.

Defined results: a null URL, or one without "://", has an empty host and path, and fits no entry; URLs may
be of any length, and the work on one grows with its length only; an empty list fits nothing; repeated
rows are all returned; entries repeated with other verdicts count as block; null entries are left out,
entries longer than ENTRY characters refused; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, materialize, prepare

BITS_EACH, MAX_BYTES, PROBES, ENTRY = 16, 64 << 20, 8, 2048
#: Entries found that are broadcast at most; more meet their rows in a shuffle, with hot keys dealt to SALTS parts.
BROADCAST_FOUND, SALTS = 200_000, 16
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_REST = re.compile(r"([^/?#]*)([^?#]*)")
_ESCAPE = re.compile("%[0-9A-Fa-f]{2}")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PORT = re.compile(r":[0-9]*$")
#: Tags of keys: a rule, a listed place with all below, a listed page.
RULE, PLACE, PAGE = "r ", "s ", "p "


def place(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL as written."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = _REST.match(url, at + 3).groups()
    return host.translate(_FOLD), path


def _plain(m: re.Match) -> str:
    c = chr(int(m[0][1:], 16))
    return c if c in _UNRESERVED else m[0].upper()


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host without user, port and final dots; path with unreserved characters unescaped and other escapes
    in capitals, dot segments resolved and runs of slashes made one; an empty path is "/"."""
    if "%" in host or "%" in path:
        host, path = _ESCAPE.sub(_plain, host).translate(_FOLD), _ESCAPE.sub(_plain, path)
    host = _PORT.sub("", host.rsplit("@", 1)[-1]).rstrip(".")
    if "//" in path or "/." in path:
        out: list[str] = []
        parts = path.split("/")[1:]
        for part in parts:
            if part == "..":
                del out[-1:]
            elif part not in ("", "."):
                out.append(part)
        below = parts[-1] in ("", ".", "..")
        path = "/" + "/".join(out) + "/" * (below and bool(out))
    return host, path or "/"


def listed_key(url: str) -> str:
    """The tagged key of a listed URL, with or without a scheme."""
    host, path = canonical(*place(url if "://" in url else f"://{url}"))
    return (PLACE if path.endswith("/") else PAGE) + host + path


def rule_key(entry: str) -> str:
    host, slash, path = entry.partition("/")
    return RULE + host.translate(_FOLD) + slash + path


def suffixes(host: str, labels: int) -> list[str]:
    """The host and what follows its dots, down to ``labels`` labels and fewer."""
    parts = host.rsplit(".", labels)
    tails = parts[1:] if len(parts) > labels else parts
    return [".".join(tails[k:]) for k in range(len(tails))]


def prefixes(path: str, folders: int, lengths: list[int]) -> list[str]:
    """The path's beginnings that end in one of its first ``folders`` slashes or have one of the lengths."""
    ends, at = set(), path.find("/")
    while at >= 0 and len(ends) < folders and at < ENTRY:
        ends.add(at + 1)
        at = path.find("/", at + 1)
    ends.update(n for n in lengths if n <= len(path))
    return [path[:n] for n in ends]


def keys_of(url: str | None, shape: dict) -> tuple[str, str, list[str]]:
    """Host, path, and every key that an entry which fits the URL may have."""
    host, path = place(url)
    if not host:
        return host, path, []
    keys = []
    if shape["rules"]:
        tails = suffixes(host, shape["rule_labels"])
        keys += [f"{RULE}{h}{p}" for p in prefixes(path, shape["rule_folders"], shape["rule_lengths"]) for h in tails]
    if shape["listed"]:
        own, below = canonical(host, path)
        if len(own) + len(below) <= ENTRY:
            keys.append(f"{PAGE}{own}{below}")
        tails = suffixes(own, shape["labels"])
        keys += [f"{PLACE}{h}{p}" for p in prefixes(below, shape["folders"], []) for h in tails]
    return host, path, keys


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8")) for k in keys), np.uint64, len(keys)).view(np.int64)


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its probes within: (n, PROBES) bit numbers below 256."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    low = h & np.uint64(0xFFFFFFFF)
    # two byte-wide steps give eight bits, as in double hashing
    odd = (low >> np.uint64(8)) | np.uint64(1)
    probes = (low[:, None] + odd[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    return block.astype(np.int64), probes.astype(np.int64)


def entries(listed: DataFrame, rules: bool) -> DataFrame:
    """key, h (its hash) and verdict of a list with columns entry and verdict."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if any(len(t) > ENTRY for t in texts):
                raise ValueError(f"an entry is longer than {ENTRY} characters")
            keys = [(rule_key if rules else listed_key)(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(_hashes(keys)), batch.column(1)], names=["key", "h", "verdict"])

    own = listed.where(F.col("entry").isNotNull()).select(F.col("entry").cast("string"), F.col("verdict").cast("string"))
    return own.mapInArrow(step, "key string, h long, verdict string")


def shape_of(own: DataFrame) -> dict:
    """What look-ups need to know of the lists: one row, and the lengths of rules' paths that end in no
    slash, of which there are no more than ENTRY."""
    where = F.substring("key", 1, 2)
    host, path = F.substring_index(F.col("key"), "/", 1), F.expr("substr(key, instr(key, '/'))")
    labels, folders = F.size(F.split(host, r"\.")), F.size(F.split(path, "/")) - 1
    most = lambda column, *tags: F.coalesce(F.max(F.when(where.isin(*tags), column)), F.lit(0))
    row = own.agg(most(F.lit(1), RULE).alias("rules"), most(F.lit(1), PLACE, PAGE).alias("listed"), most(labels, RULE).alias("rule_labels"), most(folders, RULE).alias("rule_folders"), most(labels, PLACE).alias("labels"), most(folders, PLACE).alias("folders"))
    odd = own.where((where == RULE) & ~F.col("key").endswith("/")).select(F.when(F.col("key").contains("/"), F.length(path)).otherwise(0).alias("n")).distinct()
    return {**row.first().asDict(), "rule_lengths": sorted(r["n"] for r in odd.collect())}


def build(own: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter's blocks, (n, 4) words, of the hashes ``h``. Keys' bits are joined by block where they
    are; the driver gets the blocks, of which there are no more than fit in ``max_bytes``."""
    n = own.count()
    blocks = int(max(1, min(-(-n * BITS_EACH // 256), max_bytes // 32)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, probes = _bits(batch.column(0).to_numpy(), blocks)
            words = np.zeros((len(block), 4), np.uint64)
            for k in range(PROBES):
                words[np.arange(len(block)), probes[:, k] >> 6] |= np.uint64(1) << (probes[:, k] & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, w].view(np.int64)) for w in range(4))], names=["block", "w0", "w1", "w2", "w3"])

    rows = own.select("h").mapInArrow(step, "block long, w0 long, w1 long, w2 long, w3 long")
    joined = rows.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4))).toArrow()
    out = np.zeros((blocks, 4), np.uint64)
    for batch in joined.to_batches():
        out[batch.column(0).to_numpy()] = np.stack([batch.column(w + 1).to_numpy().view(np.uint64) for w in range(4)], axis=1)
    return out


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, probes = _bits(hashes, len(words))
    own = words[block[:, None], probes >> 6]
    return ((own >> (probes & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def possible(pages: DataFrame, key: str, shape: dict, words: np.ndarray) -> DataFrame:
    """row (a number of its own), the key column, host, path and the URL's keys that the filter holds."""
    handle = broadcast_value(pages.sparkSession, words)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [keys_of(url, shape) for url in batch.column(1).to_pylist()]
            each = [k for _, _, keys in found for k in keys]
            passed = iter(contains(handle.value, _hashes(each)).tolist() if each else [])
            kept = [[k for k in keys if next(passed)] for _, _, keys in found]
            arrays = [pa.array(np.arange(row, row + len(found))), batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array(kept, pa.list_(pa.string()))]
            row += len(found)
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "host", "path", "keys"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(pages[key], pages["url"].cast("string")).mapInArrow(step, f"row long, id {kind}, host string, path string, keys array<string>")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path (both as written), rule and listed (the entry's key that decides, or null) and verdict
    of every row. Both lists have the columns entry and verdict (block or allow)."""
    prepare(pages.sparkSession)
    own = entries(rules, True).unionByName(entries(listed, False)).groupBy("key", "h").agg(F.max("verdict").alias("verdict"))  # block > allow
    own = materialize(own, "listed")
    rows = materialize(possible(pages, key, shape_of(own), build(own)), "places")
    asked = rows.where(F.size("keys") > 0).select("row", F.explode("keys").alias("key"))
    found = asked.select("key").distinct().join(own.select("key", "verdict").hint("shuffle_hash"), "key")
    found = materialize(found, "found")
    if found.count() <= BROADCAST_FOUND:
        hits = asked.join(F.broadcast(found), "key")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = asked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    own_rule, nothing = F.col("key").startswith(RULE), F.lit(0)
    rank = F.struct(own_rule, F.when(own_rule, F.length("key")).otherwise((F.col("verdict") == "block").cast("int")), F.when(own_rule, F.locate("/", F.col("key"))).otherwise(nothing), "key")
    best = hits.groupBy("row").agg(F.max_by(F.struct("key", "verdict"), rank).alias("best"))
    text = F.expr("substr(best.key, 3)")
    rule = F.col("best.key").startswith(RULE)
    return rows.drop("keys").join(best, "row", "left").select(F.col("id").alias(key), "host", "path", F.when(rule, text).alias("rule"), F.when(~rule, text).alias("listed"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
