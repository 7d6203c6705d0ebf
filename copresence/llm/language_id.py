"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of `WINDOW` bytes, once forwards and once backwards, and gives every
position a distribution over the learned languages; a document's distribution is the mean over all its positions. The units have
an update and a reset gate; gates and candidates are piecewise linear (clipped), which is cheap in numpy. It is trained here,
in numpy, by backpropagation through time on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.llm.common import id_crc

UNKNOWN = "und"
WINDOW = 96
HIDDEN = 8
#: At most so many labelled documents of each language are learned from, and so many windows of each.
MAX_DOCS = 400
WINDOWS_PER_DOC = 6
STEPS = 240
BATCH = 192
#: At most so many languages are learned, the commonest ones first.
MAX_LANGUAGES = 200
_PAD = 256
_BLOCK = 2048


@dataclass
class Network:
    """Per direction: byte table (3 x hidden rows: update, reset, candidate), recurrent weights; then the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        table = lambda: np.concatenate([rng.normal(0.5, 0.1, (2 * hidden, 257)), rng.normal(0, 0.3, (hidden, 257))]).astype(np.float32)
        net = cls(languages, [table(), table()], [rng.normal(0, 0.2, (3 * hidden, hidden)).astype(np.float32) for _ in range(2)],
                  rng.normal(0, 0.2, (len(languages), 2 * hidden)).astype(np.float32), np.zeros((len(languages), 1), np.float32))
        for t in net.tables:
            t[:, _PAD] = 0
            t[:hidden, _PAD] = -1e3  # the update gate stays shut, so padding leaves the state as it is
        return net

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.output, self.bias]


def _scan(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch) over byte codes (time, batch); `keep` receives what the way back needs."""
    steps, batch = x.shape
    hidden = recurrent.shape[1]
    states = np.empty((steps, hidden, batch), np.float32)
    h = np.zeros((hidden, batch), np.float32)
    gates, inner, cand = (np.empty((k * hidden, batch), np.float32) for k in (3, 3, 1))
    for t in range(steps):
        np.take(table, x[t], axis=1, out=gates, mode="clip")
        np.dot(recurrent, h, out=inner)
        two = gates[:2 * hidden]
        two += inner[:2 * hidden]
        if keep is not None:
            raw = two.copy()
        np.clip(two, 0, 1, out=two)
        np.multiply(inner[2 * hidden:], two[hidden:], out=cand)
        cand += gates[2 * hidden:]
        if keep is not None:
            keep.append((raw, two.copy(), inner[2 * hidden:].copy(), cand.copy(), h.copy()))
        np.clip(cand, -1, 1, out=cand)
        cand -= h
        cand *= two[:hidden]
        h += cand
        states[t] = h
    return states


def _back(recurrent: np.ndarray, x: np.ndarray, keep: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent weights."""
    hidden = recurrent.shape[1]
    d_table, d_recurrent = np.zeros((257, 3 * hidden), np.float32), np.zeros_like(recurrent)
    dh = np.zeros_like(d_states[0])
    codes = np.arange(257)[:, None]
    for t in range(len(x) - 1, -1, -1):
        raw, two, inner, cand, before = keep[t]
        update, reset = two[:hidden], two[hidden:]
        dh = dh + d_states[t]
        d_cand = dh * update * (np.abs(cand) < 1)
        open_ = (raw > 0) & (raw < 1)
        d_update = dh * (np.clip(cand, -1, 1) - before) * open_[:hidden]
        d_reset = d_cand * inner * open_[hidden:]
        d_inner = np.concatenate([d_update, d_reset, d_cand * reset])
        d_recurrent += d_inner @ before.T
        d_table += (codes == x[t]).astype(np.float32) @ np.concatenate([d_update, d_reset, d_cand]).T
        dh = dh * (1 - update) + recurrent.T @ d_inner
    return d_table.T, d_recurrent


def _positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities (time, language, batch) of byte codes (time, batch)."""
    hidden = net.recurrent[0].shape[1]
    forth = _scan(net.tables[0], net.recurrent[0], x)
    back = _scan(net.tables[1], net.recurrent[1], x[::-1])[::-1]
    return _softmax(np.matmul(net.output[:, :hidden], forth) + np.matmul(net.output[:, hidden:], back) + net.bias)


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 1) -> Network:
    """Fit on byte codes (window, time; 256 pads) with the number of a language each, by Adam on the cross-entropy of all positions."""
    net = Network.fresh(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    mean, square = [[np.zeros_like(w) for w in net.weights] for _ in range(2)]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        grads = gradients(net, windows[pick].T.astype(np.intp), labels[pick])
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(net.weights, grads, mean, square):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        for t in net.tables:
            t[:hidden, _PAD] = -1e3
    return net


def gradients(net: Network, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the positions of byte codes (time, batch), in the order of `weights`."""
    hidden = net.recurrent[0].shape[1]
    kept: list[list] = [[], []]
    forth = _scan(net.tables[0], net.recurrent[0], x, kept[0])
    back = _scan(net.tables[1], net.recurrent[1], x[::-1], kept[1])[::-1]
    wrong = _softmax(np.matmul(net.output[:, :hidden], forth) + np.matmul(net.output[:, hidden:], back) + net.bias)
    wrong[:, labels, np.arange(x.shape[1])] -= 1
    mask = (x != _PAD)[:, None, :]
    wrong *= mask / max(int(mask.sum()), 1)
    d_out = np.concatenate([np.einsum("tlb,thb->lh", wrong, forth, optimize=True), np.einsum("tlb,thb->lh", wrong, back, optimize=True)], axis=1)
    first = _back(net.recurrent[0], x, kept[0], np.matmul(net.output[:, :hidden].T, wrong))
    second = _back(net.recurrent[1], x[::-1], kept[1], np.matmul(net.output[:, hidden:].T, wrong)[::-1])
    return [first[0], second[0], first[1], second[1], d_out, wrong.sum(axis=(0, 2))[:, None]]


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all windows in the concatenated texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-lengths // size)
    ends = np.repeat(np.cumsum(lengths), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + nth * size
    return starts, np.minimum(starts + size, ends)


def _codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    at = starts + np.arange(size)[:, None]
    inside = at < ends
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)].astype(np.intp), np.intp(_PAD))


def predict(net: Network, texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean probabilities (text, language), and how many positions each language is likeliest at."""
    classes = len(net.languages)
    sums, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes), np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends = windows_of(texts, size)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), -(-lengths // size))
    # windows of one length side by side: all but a text's last one are full
    for at in range(0, len(starts), _BLOCK):
        part = slice(at, at + _BLOCK)
        x = _codes(raw, starts[part], ends[part], int((ends[part] - starts[part]).max()))
        chances = _positions(net, x)
        inside = x != _PAD
        top = chances.argmax(axis=1)
        mine = owner[part]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        for c in range(classes):
            np.add.at(sums[:, c], mine[first], np.add.reduceat(np.einsum("tb,tb->b", chances[:, c], inside, dtype=np.float64), first))
            np.add.at(labelled[:, c], mine[first], np.add.reduceat(((top == c) & inside).sum(axis=0), first))
    return sums / np.maximum(lengths, 1)[:, None], labelled


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Network:
    """Learn from documents with a language whose crc32(id as text) mod 4 is not 2: of each language the `max_docs` with the lowest
    hash of their id, and of each of them up to WINDOWS_PER_DOC windows."""
    known = docs.where(F.col(lang).isNotNull() & (id_crc(doc_id) % 4 != 2)).select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, F.lit(11)).alias("order"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    counts = sorted((r["lang"], r["n"]) for r in counts)
    if not counts:
        return Network.fresh([], HIDDEN, 1)
    # the share of hashes that leaves somewhat over `max_docs` of a language, so that no language is sorted as a whole
    low = F.lit(False)
    for name, n in counts:
        share = min(1.0, 2 * (max_docs + 50) / n)
        low = low | ((F.col("lang") == name) & (F.col("order") <= int(-(2**63) + share * (2**64 - 1025))))
    nearest = Window.partitionBy("lang").orderBy("order", "doc_id")
    ids = known.where(low).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= max_docs).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    sample = docs.select(F.col(doc_id).alias("_own"), F.col(lang).alias("_own_lang"), F.col(text).alias("_text")).join(
        F.broadcast(ids), (F.col("_own") == F.col("_id")) & (F.col("_own_lang") == F.col("_lang")))
    pieces = sample.withColumn("_raw", F.col("_text").cast("binary")).withColumn("_step", F.greatest(F.lit(WINDOW), F.floor(F.length("_raw") / WINDOWS_PER_DOC).cast("int")))
    pieces = pieces.select(F.col("_own_lang").alias("lang"), F.col("_own").alias("id"), F.posexplode(F.expr(
        f"transform(sequence(0, {WINDOWS_PER_DOC - 1}), i -> substring(_raw, i * _step + 1, {WINDOW}))")).alias("nth", "raw"))
    rows = pieces.where("length(raw) > 3").dropDuplicates(["lang", "id", "nth"]).orderBy("lang", "id", "nth").collect()
    languages = sorted({r["lang"] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    windows = np.full((len(rows), WINDOW), _PAD, np.int16)
    for i, r in enumerate(rows):
        windows[i, :len(r["raw"])] = np.frombuffer(bytes(r["raw"]), np.uint8)
    return train(windows, np.array([number[r["lang"]] for r in rows]), languages) if rows else Network.fresh([], HIDDEN, 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, shares.

    Whole texts are read. lang_pred is the language with the highest mean probability, the first by name on a tie; `score` is that
    probability, `shares` maps each language to the share of positions labelled with it. A text that is null or has no letter, and any
    text where nothing was learned, is `und` with score 0 and no shares. held_out is false for a null id. Repeated rows are judged one by one; an
    empty table gives no rows. Other columns are not read.
    """
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sure = np.flatnonzero(frame["has_letter"].to_numpy(bool)) if net.languages else np.zeros(0, int)
            texts = [frame["text"].iloc[i].encode("utf-8", "surrogatepass") for i in sure]
            names, scores, shares = [UNKNOWN] * len(frame), np.zeros(len(frame)), [{} for _ in range(len(frame))]
            if texts:
                chances, labelled = predict(net, texts)
                parts = labelled / labelled.sum(axis=1, keepdims=True)
                for i, best, chance, part in zip(sure, chances.argmax(axis=1), chances.max(axis=1), parts):
                    names[i], scores[i] = net.languages[best], min(chance, 1.0)
                    shares[i] = dict(zip(net.languages, part.tolist()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "lang_pred": names, "score": scores, "shares": shares})

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(id_crc(doc_id) % 4 == 2, F.lit(False)).alias("held_out"),
        has_letter(F.col(text)).alias("has_letter"), F.col(text).alias("text"))
    return rows.mapInPandas(judge, "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def keep_known(docs: DataFrame, net: Network, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of `docs` in a learned language, with all their columns: not `und`, and with a score of `least` or more."""
    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if not net.languages:
            return pd.Series(False, index=texts.index)
        chances, _ = predict(net, [t.encode("utf-8", "surrogatepass") for t in texts])
        return pd.Series(chances.max(axis=1) >= least, index=texts.index)

    return docs.where(has_letter(F.col(text))).where(known(F.col(text)))
