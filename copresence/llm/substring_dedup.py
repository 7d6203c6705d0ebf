"""Substring dedup by relative Lempel-Ziv parsing: passages that stand elsewhere in the corpus are found as long factors.

A window of `window` words is a duplicate if its words also start anywhere else. To parse every document against every reference block
that can hold one of its windows, and against no other, text is dealt to blocks by content. Each window has an anchor, the least hashed
run of GRAM words in it; neighbouring windows with one anchor are a piece of text (at most 62 words), and all pieces with one anchor go
to one block. Equal windows have equal anchors, so both occurrences lie in pieces of the same block.

A block sorts the suffixes of its pieces. Each piece is then factored greedily: the longest factor that also starts elsewhere in the
block, then the next one behind it. A factor of `window` words or more is a duplicate span. A duplicate window may also lie across the
border of two factors, so the starts whose windows cross a border are looked up in the same index.

Sizes: texts are counted as distinct texts, shuffled once and kept in buckets by their digest, so later steps join them without an exchange.
Equal pieces are one piece of a block (their windows are duplicates at once). An anchor with more than `hot` different pieces
is lengthened to whole windows, which are counted by their 128-bit digest, with sums before the shuffle: no block holds more than a bounded
number of words, however often a phrase stands in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from copresence.llm.common import counted, saved
from copresence.session import scratch

WINDOW = 35
GRAM = 8
#: Different pieces in one reference block, and of one anchor, at most.
BLOCK = 8192
HOT = 16384
#: Bytes of text that a task cuts at once.
_SLICE = 1 << 20
_SEED = 11


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than `[\\x20\\x09-\\x0D]`."""
    return text.encode("utf-8", "surrogatepass").split()


def gram_of(window: int) -> int:
    """Words of an anchor: few, but so many that a piece has at most 62 windows."""
    return max(min(GRAM, window), window - 61)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the smallest of `width` values from each place stands."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = at[:-step], at[step:]
        at = at.copy()
        at[:-step] = np.where(values[right] < values[left], right, left)
        done += step
    return at


def pieces(docs: list[list[bytes]], window: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Of several documents, each a list of words: (document, first window, number of windows, anchor, digest of the words) of every piece."""
    gram = gram_of(window)
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = [w for d in docs for w in d]
    if (sizes < window).all():
        return
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(w, _SEED) for w in flat], np.uint64)
    grams, done = hashed, 1
    while done < gram:  # order counts: each step weighs its left half by an odd number
        step = min(done, gram - done)
        right = np.concatenate([grams[step:], np.zeros(step, np.uint64)])
        grams = (grams * np.uint64(0x9E3779B97F4A7C15 + 2 * done)) ^ ((right >> np.uint64(29)) + right * np.uint64(0xBF58476D1CE4E5B9))
        done += step
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x94D049BB133111EB)
    grams ^= grams >> np.uint64(32)
    anchor = _least(grams, window - gram + 1)
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())  # all windows inside a document
    own = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(np.append(first, len(starts)))
    line = b" ".join(flat)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
    at = starts[first]
    left = np.where(at > 0, ends[at - 1] + 1, 0).tolist()
    right = ends[at + n + window - 2].tolist()
    doc = np.repeat(np.arange(len(docs)), counts)[first]
    whole = xxhash.xxh128_digest
    yield from zip(doc.tolist(), (at - begins[doc]).tolist(), n.tolist(), grams[own[first]].view(np.int64).tolist(), [whole(line[a:b], _SEED) for a, b in zip(left, right)])


class Reference:
    """An index over pieces of text: the order of all their suffixes, with the order by each power of two of words."""

    def __init__(self, texts: list[list[bytes]]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        codes, known = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
        flat = np.empty(len(codes) + len(texts), np.int64)
        last = self.begins + self.sizes
        inside = np.ones(len(flat), bool)
        inside[last] = False
        flat[inside] = codes
        flat[last] = len(known) + np.arange(len(texts))  # every piece ends in a word of its own
        self.ranks = [flat]
        while 1 << (len(self.ranks) - 1) <= self.sizes.max(initial=0):
            width, rank = 1 << (len(self.ranks) - 1), self.ranks[-1]
            after = np.full(len(rank), rank.max(initial=0) + 1)
            after[:-width] = rank[width:]
            self.ranks.append(np.unique(rank * (after.max(initial=0) + 1) + after, return_inverse=True)[1])
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes from two places share."""
        n = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            n += (rank[a + n] == rank[b + n]).astype(np.int64) << level
        return n

    def longest(self, at: np.ndarray) -> np.ndarray:
        """The longest run of words from each place that also starts at another place: its neighbours in the order have it."""
        out = np.zeros(len(at), np.int64)
        for side in (-1, 1):
            near = self.place[at] + side
            real = (near >= 0) & (near < len(self.order))
            out[real] = np.maximum(out[real], self.common(at[real], self.order[near[real]]))
        return out

    def duplicates(self, window: int) -> np.ndarray:
        """For every place whether a window from there also starts elsewhere."""
        found = np.zeros(len(self.order) + 1, bool)
        at, last = self.begins.copy(), self.begins + self.sizes - window  # the last window's start
        live = np.flatnonzero(at <= last)
        while len(live):  # one factor of every piece a round
            p = at[live]
            size = self.longest(p)
            border = p + np.maximum(size, 1)
            long = size >= window
            found[_places(p[long], np.minimum(p[long] + size[long] - window, last[live][long]))] = True
            crossing = _places(np.maximum(p + 1, p + size - window + 1), np.minimum(border - 1, last[live]))
            found[crossing[self.longest(crossing) >= window]] = True
            at[live] = border
            live = live[border <= last[live]]
        return found[:-1]

    def masks(self, window: int) -> list[int]:
        """For each piece the bits of its duplicate windows."""
        found = self.duplicates(window)
        out = []
        for begin, size in zip(self.begins.tolist(), self.sizes.tolist()):
            out.append(sum(1 << int(i) for i in np.flatnonzero(found[begin:begin + max(size - window + 1, 0)])))
        return out


def _places(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers from `first` to `last` of each pair."""
    n = np.maximum(last - first + 1, 0)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def keep_words(words: list[bytes], cuts: list[tuple[int, int]], window: int) -> list[bytes]:
    """The words outside all windows named by (first window, bits)."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, mask in cuts:
        while mask:  # a run of bits is one span
            low = (mask & -mask).bit_length() - 1
            run = ((mask >> low) ^ ((mask >> low) + 1)).bit_length() - 1
            edge[start + low] += 1
            edge[start + low + run + window - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a frame with about `_SLICE` characters of text each."""
    size = frame["text"].str.len().cumsum().to_numpy() // _SLICE
    for part in np.unique(size):
        yield frame[size == part]


def _cut(window: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame):
                keys, copies = part["key"].tolist(), part["copies"].tolist()
                found = list(pieces([words_of(t) for t in part["text"]], window))
                if not found:
                    continue
                doc, start, n, anchor, seg = zip(*found)
                yield pd.DataFrame({"key": [keys[d] for d in doc], "start": pd.Series(start, dtype="int32"), "n": pd.Series(n, dtype="int32"),
                                    "anchor": pd.Series(anchor, dtype="int64"), "seg": list(seg), "copies": pd.Series([copies[d] for d in doc], dtype="int64")})

    return cut


def _extract(window: int):
    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame):
                out = []
                for text, wanted in zip(part["text"], part["wanted"]):
                    words = words_of(text)
                    out += [(w["anchor"], w["seg"], w["copies"], b" ".join(words[w["start"]:w["start"] + w["n"] + window - 1])) for w in wanted]
                yield pd.DataFrame(out, columns=["anchor", "seg", "copies", "words"])

    return extract


def _full(n: int) -> int:
    return (1 << n) - 1


def _parse(window: int):
    def parse(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        texts = [w.split() for w in block["words"]]
        masks = [_full(len(t) - window + 1) if copies > 1 else mask for t, mask, copies in zip(texts, Reference(texts).masks(window), block["copies"])]
        found = [(seg, mask) for seg, mask in zip(block["seg"], masks) if mask]
        return pd.DataFrame({"seg": pd.Series([seg for seg, _ in found], dtype=object), "mask": pd.Series([mask for _, mask in found], dtype="int64")})

    return parse


def _windows(window: int):
    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part, out = frame.iloc[at:at + 2000], []
                for seg, copies, line in zip(part["seg"], part["copies"], part["words"]):
                    words = line.split()
                    out += [(seg, i, copies, xxhash.xxh128_digest(b" ".join(words[i:i + window]), _SEED)) for i in range(len(words) - window + 1)]
                yield pd.DataFrame(out, columns=["seg", "i", "copies", "at"])

    return windows


def _keep(window: int, with_text: bool):
    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame):
                out = []
                for key, text, cuts in zip(part["key"], part["text"], part["cuts"]):
                    words = words_of(text)
                    kept = words if cuts is None else keep_words(words, [(c["start"], c["mask"]) for c in cuts], window)
                    line = b" ".join(kept)
                    row = (key, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest())
                    out.append((*row, line.decode("utf-8", "surrogatepass")) if with_text else row)
                yield pd.DataFrame(out, columns=["key", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return keep


def _bucketed(df: DataFrame, key: str, label: str) -> tuple[str, DataFrame]:
    """Write in buckets of a column, in the shared folder; tables joined on it need no exchange of these rows."""
    spark = df.sparkSession
    path = scratch(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return name, spark.table(name)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_sha256, and `kept_text` on request.

    Every occurrence of a repeated window goes, the first one too; windows are judged on the input. Null and empty texts have no words; texts with
    fewer words than a window keep all. Of repeated rows and equal texts all windows are repeated. Rows with a null id are documents like others, and rows
    that share an id are judged one by one. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.md5(whole.cast("binary")).alias("key"))
    once = docs.select(F.md5(whole.cast("binary")).alias("key"), whole.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, texts = _bucketed(once, "key", "texts")
    try:
        runs = saved(texts.select("key", "text", "copies").mapInPandas(_cut(window), "key string, start int, n int, anchor long, seg binary, copies long"), "runs")
        anchors = runs.groupBy("anchor").agg(F.sum("copies").alias("all_copies"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("all_copies > 1")
        anchors = saved(anchors.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
        again = saved(runs.join(anchors.hint("merge"), "anchor"), "repeated-anchors")
        segs = again.where("mixed").groupBy("anchor", "seg").agg(F.min(F.struct("key", "start", "n")).alias("at"), F.sum("copies").alias("copies"))
        segs = saved(segs.select("anchor", "seg", "copies", "at.*"), "pieces-to-parse")
        wanted = segs.groupBy("key").agg(F.collect_list(F.struct("anchor", "seg", "copies", "start", "n")).alias("wanted"))  # at most a document's pieces
        text_of = texts.select("key", "text").join(wanted.hint("merge"), "key").select("text", "wanted")
        parts, seen = counted(text_of.mapInPandas(_extract(window), "anchor long, seg binary, copies long, words binary"), "pieces")
        many = saved(segs.groupBy("anchor").agg(F.count("*").alias("pieces")).where(F.col("pieces") > hot).select("anchor"), "hot-anchors")
        masks = _masks(parts, many, window, 1 + seen["n"] // block)
        alone = again.where("not mixed").groupBy("seg").agg(F.expr("shiftleft(1L, max(n)) - 1").alias("mask"))
        masks = saved(masks.unionByName(alone), "masks")
        cuts = again.join(masks, "seg").select("key", F.struct("start", "mask").alias("cut")).groupBy("key").agg(F.collect_list("cut").alias("cuts"))
        schema = "key string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        kept = saved(texts.select("key", "text").join(cuts.hint("merge"), "key", "left").mapInPandas(_keep(window, with_text), schema), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return ids.join(kept, "key").drop("key")


def _masks(parts: DataFrame, many: DataFrame, window: int, blocks: int) -> DataFrame:
    """(seg, mask) of all pieces with a duplicate window; pieces of the anchors in `many` by their whole windows."""
    dealt = parts.join(many, "anchor", "left_anti").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).drop("anchor")
    parsed = dealt.repartition(min(blocks, 10_000), "block").groupBy("block").applyInPandas(_parse(window), "seg binary, mask long")
    whole = parts.join(many, "anchor", "left_semi").select("seg", "copies", "words").mapInPandas(_windows(window), "seg binary, i int, copies long, at binary")
    whole = saved(whole, "windows")
    twice = whole.groupBy("at").agg(F.sum("copies").alias("n")).where("n > 1").select("at")
    counted_ = whole.join(twice, "at").groupBy("seg").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return parsed.unionByName(counted_)
