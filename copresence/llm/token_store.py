"""Token-id shards with a minimal perfect hash index for keyed access in constant time.

A store is a folder with

* `shard-*.ids`: raw little-endian ids of whole documents, each followed by the end id, in ascending document order; two bytes an id
  if the vocabulary allows it, else four;
* `index-*.mph`: for the keys of one hash bucket a minimal perfect hash, and at each key's slot its fingerprint and the
  document's shard, offset and length;
* `manifest.parquet`, `index.parquet`: one row per shard, one per index file.

Shards come from a range partitioning by document id, one task writing one file under a name of its own attempt; only files
named in the two tables belong to the store, so a repeated task does no harm. A key is (document id, copy): copies of one id
count from 0. Files are written and read through `pyarrow.fs`, which takes the same folder uri on every worker.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from copresence.llm.common import qualified, saved
from copresence.session import scratch

END = 1
#: Keys of one index file.
BUCKET_KEYS = 100_000
_LEVELS = 64
_GAMMA = 2.0
#: Words remembered by each Python worker.
_REMEMBERED = 1_000_000
#: Bytes of text encoded at once.
_CHUNK = 16 << 20
#: Ids read at once.
_READ_IDS = 1 << 22
_NONE = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- encoding

class WordEncoder:
    """Ids of whole texts, batch by batch.

    The tokenizer drops blanks, cuts a text there and then by its pattern, and encodes each part by itself. So the distinct words of
    a batch are encoded once, and the ids of a text are gathered from them. Of a word's parts the last id, and no other, is that of an
    end of a word: new parts go to the library in one go and are told apart by their ends. Parts are found here for words of
    U+0000 to U+00FF; other words go to the library as they are.
    """

    # fixed values: the tokenizer's pattern on lower-case text of U+0000 to U+00FF, and its blanks in that range
    _PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾\x85\xa0]+", re.ASCII)
    _WORD_END = "</w>"

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a word are ordinary text
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        strings = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._strings = "|".join(map(re.escape, strings))
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for part, i in vocabulary.items() if part.endswith(self._WORD_END)]] = True
        self.dtype = np.dtype(dtype)
        self._end = np.array([END], self.dtype).tobytes()
        self._known: dict[str, bytes] = {}

    def encode_whole(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """As `encode`, but a special token's string in a text is that token, as the library has it.

        Texts that hold such a string go to the library whole: it cuts there before it lower-cases or drops blanks.
        """
        held = pc.match_substring_regex(texts.fill_null(""), self._strings).to_numpy(zero_copy_only=False) if self._strings else np.zeros(len(texts), bool)
        if not held.any():
            return self.encode(texts)
        self._tokenizer.encode_special_tokens = False
        try:
            whole = self._tokenizer.encode_batch_fast(texts.filter(pa.array(held)).to_pylist(), add_special_tokens=False)
        finally:
            self._tokenizer.encode_special_tokens = True
        whole = iter([np.array(w.ids, self.dtype).tobytes() + self._end for w in whole])
        line, counts = self.encode(texts.filter(pa.array(~held)))
        lengths = np.zeros(len(texts), np.int64)
        lengths[~held] = counts
        out, at = [], 0
        for i, special in enumerate(held.tolist()):
            if special:
                out.append(next(whole))
                lengths[i] = len(out[-1]) // self.dtype.itemsize
            else:
                upto = at + int(lengths[i]) * self.dtype.itemsize
                out.append(line[at:upto])
                at = upto
        return b"".join(out), lengths

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts in a row, each with the end id, and the number of ids of each; special tokens' strings are ordinary text."""
        if not len(texts):
            return b"", np.zeros(0, np.int64)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        upto = words.offsets.to_numpy().astype(np.int64)
        upto -= upto[0]
        coded = words.flatten().dictionary_encode()
        codes = [*self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), self._end]
        line = np.insert(coded.indices.to_numpy(zero_copy_only=False), upto[1:], len(codes) - 1)
        sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // self.dtype.itemsize
        starts, ids, taken = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(codes), self.dtype), sizes[line]
        before = np.cumsum(taken, dtype=np.int32) - taken
        at = np.repeat(starts[line] - before, taken)
        at += np.arange(len(at), dtype=np.int32)
        return ids[at].tobytes(), np.add.reduceat(taken, upto[:-1] + np.arange(len(upto) - 1), dtype=np.int64)

    def _codes(self, words: list[str]) -> list[bytes]:
        if len(self._known) > _REMEMBERED:
            self._known = {}
        known = self._known
        codes = list(map(known.get, words))
        cut = {i: self._parts(words[i]) for i, code in enumerate(codes) if code is None}
        self._learn({part for parts in cut.values() for part in parts or () if part not in known}, [words[i] for i, parts in cut.items() if parts is None])
        for i, parts in cut.items():
            codes[i] = known[words[i]] if parts is None else b"".join([known[part] for part in parts])
            known[words[i]] = codes[i]
        return codes

    def _parts(self, word: str) -> list[str] | None:
        if word.isascii():
            if word.isalpha():
                return [word]
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return [word[:-1], word[-1]]
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return self._PARTS.findall(word.lower())

    def _learn(self, parts: set[str], others: list[str]) -> None:
        new = list(parts)
        if new:
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids)
            raw, wide = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            cuts = ((np.flatnonzero(self._ends[ids]) + 1) * wide).tolist()
            if len(cuts) != len(new):
                raise ValueError("a part of a word has more than one end")
            at = 0
            for part, cut in zip(new, cuts):
                self._known[part] = raw[at:cut]
                at = cut
        for word, code in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self._known[word] = np.array(code.ids, self.dtype).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


# ---------------------------------------------------------------- minimal perfect hash

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, named: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of (id, copy); rows that are not `named` have no id."""
    base = np.where(named, _mix(ids.astype(np.int64).view(np.uint64), 1), _NONE)
    return _mix(base ^ _mix(copies.astype(np.int64).view(np.uint64), 2 + seed), 3 + seed)


class PerfectHash:
    """Distinct 64-bit hashes to 0..n-1 by a cascade of bit arrays: on each level the keys alone at their bit are settled, the
    others go to the next level. A key's slot is the rank of its bit, so a lookup costs a few reads, whatever n is."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], hashes
        while len(rest):
            if len(sizes) == _LEVELS:
                raise ValueError("hashes are not distinct")
            size = max(64, int(np.ceil(_GAMMA * len(rest) / 64)) * 64)
            at = (_mix(rest, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no level holds it."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(hashes[open_], 100 + level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = (self.ranks[word] + below)[here]
            open_ = open_[~here]
        return out


class Index:
    """One index file: slot arrays of fingerprints and places behind a perfect hash."""

    def __init__(self, seed: int, hashing: PerfectHash, prints: np.ndarray, places: np.ndarray):
        self.seed, self.hashing, self.prints, self.places = seed, hashing, prints, places

    @classmethod
    def build(cls, ids: np.ndarray, named: np.ndarray, copies: np.ndarray, places: np.ndarray) -> Index:
        """places: shard, offset, length per key. A seed is sought for which all hashes differ."""
        for seed in range(1000):
            hashes = key_hash(ids, named, copies, seed)
            if len(np.unique(hashes)) == len(hashes):
                hashing = PerfectHash.build(hashes)
                slots = hashing.slots(hashes)
                prints, at = np.zeros(len(hashes), "<u4"), np.zeros((len(hashes), 3), "<i8")
                prints[slots], at[slots] = cls._prints(hashes), places
                return cls(seed, hashing, prints, at)
        raise ValueError("a key occurs twice")

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return (_mix(hashes, 77) >> np.uint64(32)).astype("<u4")

    def find(self, ids: np.ndarray, named: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are stored, and the places of those that are."""
        hashes = key_hash(ids, named, copies, self.seed)
        slots = self.hashing.slots(hashes)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == self._prints(hashes[found])
        return found, self.places[slots[found]]

    def dump(self) -> bytes:
        head = np.array([self.seed, len(self.hashing.sizes), len(self.hashing.bits), len(self.prints)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.hashing.sizes.astype("<i8"), self.hashing.bits, self.prints, self.places))

    @classmethod
    def load(cls, raw: bytes) -> Index:
        seed, levels, words, n = np.frombuffer(raw, "<i8", 4).tolist()
        at = 32
        sizes = np.frombuffer(raw, "<i8", levels, at)
        bits = np.frombuffer(raw, "<u8", words, at := at + 8 * levels)
        prints = np.frombuffer(raw, "<u4", n, at := at + 8 * words)
        places = np.frombuffer(raw, "<i8", 3 * n, at + 4 * n).reshape(-1, 3)
        return cls(seed, PerfectHash(sizes, bits), prints, places)


# ---------------------------------------------------------------- files

def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `_CHUNK` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // _CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _runs(ids: list, last: tuple) -> tuple[list[int], tuple]:
    """How many rows with the same id came before each row of sorted ids."""
    out, (value, count) = [], last
    for i in ids:
        count = count + 1 if i == value else 0
        value = i
        out.append(count)
    return out, (value, count)


def write_store(docs: DataFrame, vocabulary: str, size: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode every text into shards; returns (manifest, entries).

    entries: doc_id, copy, shard, offset, n_tokens (offset in ids). `size`: number of ids of the vocabulary. Rows come in ascending id
    order, null ids first; copies of one id in the order of a hash of their text. Spark sizes the shards
    (`spark.sql.adaptive.advisoryPartitionSizeInBytes`).
    """
    spark, dtype = docs.sparkSession, "<u2" if size <= 1 << 16 else "<u4"
    wide = np.dtype(dtype).itemsize

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, name, offset, seen = encoder(vocabulary, dtype).encode_whole, None, f"shard-{uuid.uuid4().hex}.ids", 0, (object(), 0)
        try:
            for batch in batches:
                for part in _slices(batch):
                    if out is None:
                        files, path = _opened(folder)
                        files.create_dir(path, recursive=True)
                        out = files.open_output_stream(f"{path}/{name}")
                    ids, lengths = encode(part.column("text"))
                    out.write(ids)
                    copies, seen = _runs(part.column("doc_id").to_pylist(), seen)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(copies, pa.int64()), pa.array([name] * len(part)), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths)],
                        names=["doc_id", "nth", "file", "offset", "n_tokens"])
                    offset += int(lengths.sum())
        finally:
            if out is not None:
                out.close()

    order = ["doc_id", "print", "row"]  # the last two spread rows of one id
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    )
    written = saved(ordered.mapInArrow(write_shard, "doc_id long, nth long, file string, offset long, n_tokens long"), "entries")
    named = F.col("doc_id").isNotNull().alias("named")
    parts = written.groupBy("file").agg(
        F.min(F.struct(named, "doc_id")).alias("first"), F.max(F.struct(named, "doc_id", "nth")).alias("last"),
        F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs")).collect()  # a row per shard
    # shards of one id only may stand in any order among themselves
    parts.sort(key=lambda p: (p["first"]["named"], p["first"]["doc_id"] or 0, p["last"]["named"], p["last"]["doc_id"] or 0, p["file"]))
    rows, start, held = [], 0, (object(), 0)
    for number, part in enumerate(parts):
        first, last = part["first"]["doc_id"], part["last"]["doc_id"]
        before = held[1] if first == held[0] else 0
        rows.append((part["file"], number, start, part["n_ids"], part["n_docs"], first, before))
        start += part["n_ids"]
        held = (last, part["last"]["nth"] + 1 + (before if first == last else 0))
    manifest = spark.createDataFrame(rows, "file string, shard long, start long, n_ids long, n_docs long, first_id long, copies_before long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest.parquet")
    manifest = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest.parquet")
    copy = F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("copies_before")).otherwise(0)
    return manifest, written.join(manifest, "file").select("doc_id", copy.alias("copy"), "shard", "offset", "n_tokens")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket")


def _keys(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = frame["doc_id"].astype("Int64")
    return ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(), frame["copy"].to_numpy(np.int64)


def write_index(entries: DataFrame, folder: str, buckets: int) -> DataFrame:
    """One perfect hash file per hash bucket of keys; returns (bucket, buckets, index_file) and keeps it as `index.parquet`."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        index = Index.build(*_keys(frame), frame[["shard", "offset", "n_tokens"]].to_numpy(np.int64))
        files, path = _opened(folder)
        name = f"index-{uuid.uuid4().hex}.mph"
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(index.dump())
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]], "buckets": [buckets], "index_file": [name]})

    built = entries.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(build, "bucket int, buckets int, index_file string")
    built.write.parquet(f"{folder}/index.parquet")
    return entries.sparkSession.read.schema(built.schema).parquet(f"{folder}/index.parquet")


def find(keys: DataFrame, folder: str) -> DataFrame:
    """The places (doc_id, copy, shard, offset, n_tokens) of keys (doc_id, copy); keys that are not in the store give no row."""
    index = keys.sparkSession.read.parquet(f"{folder}/index.parquet")
    known = index.select("buckets").first()
    buckets = known["buckets"] if known else 1

    def look_up(frame: pd.DataFrame) -> pd.DataFrame:
        files, path = _opened(folder)
        with files.open_input_file(f"{path}/{frame['index_file'].iloc[0]}") as raw:
            index = Index.load(raw.read())
        found, places = index.find(*_keys(frame))
        out = frame.loc[found, ["doc_id", "copy"]].reset_index(drop=True)
        return out.assign(doc_id=out["doc_id"].astype("Int64"), **dict(zip(("shard", "offset", "n_tokens"), places.T)))

    return (
        keys.select("doc_id", "copy", _bucket(buckets)).join(index.select("bucket", "index_file"), "bucket")
        .groupBy("bucket").applyInPandas(look_up, "doc_id long, copy long, shard long, offset long, n_tokens long")
    )


def read(keys: DataFrame, folder: str, size: int, with_ids: bool = True) -> DataFrame:
    """The documents of keys (doc_id, copy): doc_id, copy, start, n_tokens, ids_crc32, and `ids` (array of int) unless left out.

    start counts the ids of all documents before this one; ids_crc32 is over the ids as little-endian 32-bit integers.
    """
    manifest = keys.sparkSession.read.parquet(f"{folder}/manifest.parquet").select("shard", "file", F.col("start").alias("shard_start"))
    dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def fetch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset", ignore_index=True)
        files, path = _opened(folder)
        first, last = frame["offset"].to_numpy(), (frame["offset"] + frame["n_tokens"]).to_numpy()
        crcs, ids = [], []
        with files.open_input_file(f"{path}/{frame['file'].iloc[0]}") as raw:
            at = 0
            while at < len(frame):
                end = at + 1  # neighbours are read together
                while end < len(frame) and first[end] == last[end - 1] and last[end] - first[at] <= _READ_IDS:
                    end += 1
                block = np.frombuffer(raw.read_at(int(last[end - 1] - first[at]) * dtype.itemsize, int(first[at]) * dtype.itemsize), dtype)
                for i in range(at, end):
                    mine = block[first[i] - first[at]:last[i] - first[at]].astype("<u4")
                    crcs.append(zlib.crc32(mine))
                    if with_ids:
                        ids.append(mine.astype(np.int32))
                at = end
        out = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "copy": frame["copy"], "start": frame["shard_start"] + frame["offset"], "n_tokens": frame["n_tokens"], "ids_crc32": crcs})
        return out.assign(ids=ids) if with_ids else out

    schema = "doc_id long, copy long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return find(keys, folder).join(manifest, "shard").groupBy("shard").applyInPandas(fetch, schema)


def store(docs: DataFrame, vocabulary: str, size: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Write shards, manifest and index; returns the folder and the keys (doc_id, copy) that it holds.

    A null text counts as empty (its only id is the end id). Rows with a null id are stored as copies of the null key, rows that share an
    id as copies of it, so nothing is lost. An empty table gives a store without keys. Other columns are not read.
    """
    folder = qualified(docs.sparkSession, folder or scratch(docs.sparkSession, "token-store"))
    manifest, entries = write_store(docs, vocabulary, size, folder, doc_id, text)
    total = manifest.agg(F.sum("n_docs")).first()[0] or 0
    write_index(entries, folder, max(1, -(-total // BUCKET_KEYS)))
    return folder, entries.select("doc_id", "copy")
