"""URL filters over a sorted digest array.

The rules are stored in one file: a sorted array of the 64-bit xxhash keys of their strings, the place of each string, its
verdict, and the strings. The file is written to the shared folder, shipped to the executors with `addFile`, and memory-mapped
there. A url is tried against every host suffix and every path prefix of a length that some rule has: the keys of all these
candidates are probed with one vectorised binary search per batch, and a hit counts only when the stored string is equal.
"""

from __future__ import annotations

import functools
import io
import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copresence.session import shared_dir

ALLOW, BLOCK = "allow", "block"
#: Largest rule file that is shipped to every executor.
MAX_BYTES = 1 << 30
_MAGIC = b"urlrules1"


def pack(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file for (verdict, rule) pairs; a rule is host, then path. Of a rule given twice the last verdict holds.

    Layout: magic, number of rules, number of path lengths, path lengths (u64), then arrays sorted by key: keys (u64), string ends
    (u64), verdicts (u8; 1 blocks); then the strings.
    """
    verdicts = {}
    for verdict, rule in rules:
        if verdict not in (ALLOW, BLOCK) or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, slash, path = rule.partition("/")
        verdicts[_lower(host) + slash + path] = verdict
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r, v) for r, v in verdicts.items())
    strings = [r.encode() for _, r, _ in keyed]
    lengths = sorted({len(r) - r.index("/") for r in verdicts})
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<QQ", len(keyed), len(lengths)))
    out.write(np.array(lengths, "<u8").tobytes())
    out.write(np.array([k for k, _, _ in keyed], "<u8").tobytes())
    out.write(np.cumsum([len(s) for s in strings], dtype="<u8").tobytes() if strings else b"")
    out.write(np.array([v == BLOCK for _, _, v in keyed], "u1").tobytes())
    out.write(b"".join(strings))
    return out.getvalue()


def _lower(host: str) -> str:
    """A-Z only."""
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        at = len(_MAGIC) + 16
        if raw[: len(_MAGIC)].tobytes() != _MAGIC:
            raise ValueError(f"{path} is not a rule file")
        n, m = struct.unpack("<QQ", raw[len(_MAGIC):at].tobytes())
        take = lambda kind, count, size: (raw[at:at + count * size].view(kind), at + count * size)
        lengths, at = take("<u8", m, 8)
        self.lengths = lengths.tolist()
        self.keys, at = take("<u8", n, 8)
        self.ends, at = take("<u8", n, 8)
        self.blocks, at = take("u1", n, 1)
        self.strings = raw[at:]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0:int(self.ends[i])].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The position of each candidate, -1 where it is not a rule."""
        if not len(self.keys) or not candidates:
            return np.full(len(candidates), -1)
        digest = xxhash.xxh64_intdigest
        keys = np.fromiter(map(digest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(candidates), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = int(at[i])  # equal keys stand side by side
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.string(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found


@functools.lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def _suffixes(host: str) -> Iterator[str]:
    yield host
    while "." in host:
        host = host[host.index(".") + 1:]
        yield host


def judge(rules: DigestArray, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
    """(rule, verdict) per url. Distinct (host, path start) pairs are probed once; the longest rule wins, then the longest host.

    A url that no rule fits is not on the list, so it is allowed."""
    longest = max(rules.lengths, default=0)
    starts = [(h, p[:longest]) for h, p in zip(hosts, paths)]
    tries: dict[tuple[str, str], list[int]] = {}
    candidates: dict[bytes, int] = {}
    for host, path in starts:
        if (host, path) not in tries:
            tries[host, path] = [
                candidates.setdefault((end + path[:n]).encode("utf-8", "surrogatepass"), len(candidates))
                for end in _suffixes(host) for n in rules.lengths if n <= len(path)]
    found = rules.find(list(candidates))
    names = {i: rules.string(int(i)) for i in np.unique(found) if i >= 0}
    best = {}
    for key, mine in tries.items():
        hits = [found[i] for i in mine if found[i] >= 0]
        top = max(hits, key=lambda i: (len(names[i]), names[i].index(b"/")), default=None)
        best[key] = (None, ALLOW) if top is None else (names[top].decode(), BLOCK if rules.blocks[top] else ALLOW)
    return [best[key] for key in starts]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the rule file to the shared folder and have every executor fetch it; returns its name."""
    data = pack(rules)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{len(data)} bytes of rules; at most {MAX_BYTES} are shipped to each executor")
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(conf).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the url's path starts with the rule's path; the longest rule wins, and where no rule
    fits, the url is not on the list and is allowed. A null or empty url, or one without `://`, has an empty host and path and fits no
    rule. Repeated pages are judged one by one. An empty table or an empty list of rules works. Other columns are not read.
    """
    name = ship(pages.sparkSession, rules)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored = _opened(os.path.realpath(SparkFiles.get(name)))
        for frame in frames:
            verdicts = judge(stored, frame["host"].tolist(), frame["path"].tolist())
            yield frame.assign(page_id=frame["page_id"].astype("Int64"), rule=[r for r, _ in verdicts], verdict=[v for _, v in verdicts])

    parts = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return parts.mapInPandas(judged, "page_id long, host string, path string, rule string, verdict string")
