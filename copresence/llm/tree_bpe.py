"""Byte-level BPE encoding as a reduction over trees, and decoding up the tree.

The pattern cuts a text into matches, and each match is encoded by itself. Both steps go by halves.

Matches. A leaf of a text is matched as if it were a whole text, two neighbours are joined by matching a window around their border
again. The join relies on two facts:

* A match is settled once the text reaches `LOOK` characters past its end: no alternative of the pattern looks further
  ahead than a contraction's two letters, or a run of blanks and one character.
* Matching depends on nothing before its start. From a place where both the window and the right piece start a match,
  both go on alike.

So the settled matches of the left piece stay, matching starts again behind them, and the window grows until one of its settled
matches ends where a match of the right piece starts.

Tokens. A leaf of a match is a few bytes, merged by rank. Two neighbours are joined by encoding a window again, the last tokens of the left and the first
of the right, and the window grows on a side until its outermost token there is the one that stood there before. Then all tokens outside are
final: token sequences are encodings exactly if each two neighbours are the encoding of their bytes, because merges inside a token do not
depend on what stands around it until a merge crosses its border, and the first merge to cross a border is one that
the two tokens beside it would make alone. Outside the window no two neighbours have changed, inside all were encoded together.

Both operations are associative; an empty piece is their neutral element.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

LOOK = 3
#: Characters of a leaf of a text, bytes of a leaf of a match.
LEAF = 1024
BYTES = 12
_WINDOW = 64
#: Up to so many bytes the next merge is looked for in all pairs, beyond in a heap.
_FEW = 64
#: Bytes of a piece whose tokens are remembered.
_SHORT = 16
#: No token.
_NONE = 1 << 62
#: Matches remembered by each Python worker.
_REMEMBERED = 300_000
#: Rows put out at once.
_ROWS = 200


def latin(pattern: str) -> str:
    """The pattern for texts of U+0000 to U+00FF, with its classes of characters spelled out: the standard engine is faster."""
    chars = [chr(i) for i in range(256)]
    members = {
        r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
        r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
        r"\s": [c for c in chars if regex.match(r"\s", c)],
    }
    spelled = {name: "".join(map(re.escape, found)) for name, found in members.items()}
    spelled[r"\S"] = f"[^{spelled[r'\s']}]"
    inside, out = False, []
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        inside = token == "[" or inside and token != "]"
        out.append(token if token not in spelled else spelled[token] if inside or token == r"\S" else f"[{spelled[token]}]")
    return "".join(out)


class Vocabulary:
    """Ranks, and the ids of single matches."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = Ranks((base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip()))
        self._any = regex.compile(pattern).findall
        self._latin = re.compile(latin(pattern)).findall
        self.names = [str(i) for i in range(max(self.ranks.values(), default=0) + 1)]
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._known: dict[str, tuple[int, ...]] = {}

    def matches(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def ids(self, match: str) -> tuple[int, ...]:
        """A match that is a token as a whole is that token, whether or not merges lead to it; others are reduced by halves."""
        known = self._known.get(match)
        if known is None:
            data = match.encode()
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else tuple([self.ranks[t] for t in tree_tokens(self.ranks, data)])
            if len(match) <= 32:
                if len(self._known) >= _REMEMBERED:
                    self._known.clear()
                self._known[match] = known
        return known


class Ranks(dict):
    """Ranks of tokens, and the tokens of short pieces met before: the same syllables stand in many words."""

    def __init__(self, *args):
        super().__init__(*args)
        self.pieces: dict[bytes, tuple[bytes, ...]] = {}

    def tokens(self, data: bytes) -> tuple[bytes, ...]:
        """`merged`, remembered for short pieces."""
        found = self.pieces.get(data)
        if found is None:
            found = tuple(merged(self, data))
            if len(data) <= _SHORT:
                if len(self.pieces) >= 2 * _REMEMBERED:
                    self.pieces.clear()
                self.pieces[data] = found
        return found


def merged(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The tokens of some bytes: of all neighbours that make a token the ones of least rank merge first, ties from the left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    if len(parts) > _FEW:
        return _merged_by_heap(ranks, parts)
    rank = ranks.get
    pairs = [rank(data[i:i + 2], _NONE) for i in range(len(data) - 1)]
    while pairs and (low := min(pairs)) != _NONE:
        at = pairs.index(low)
        whole = parts[at] + parts.pop(at + 1)
        parts[at] = whole
        del pairs[at]
        if at:
            pairs[at - 1] = rank(parts[at - 1] + whole, _NONE)
        if at < len(pairs):
            pairs[at] = rank(whole + parts[at + 1], _NONE)
    return parts


def _merged_by_heap(ranks: dict[bytes, int], parts: list[bytes]) -> list[bytes]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has merged meanwhile
        parts[i] += parts[j]
        parts[j] = b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p]


def join_tokens(ranks: Ranks, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
    """The tokens of two neighbouring pieces as one, from the tokens of each."""
    if not left or not right:
        return left or right
    n, i, j = len(left), 1, 1
    while True:
        window = ranks.tokens(left[-1] + right[0] if i == j == 1 else b"".join(left[n - i:] + right[:j]))
        left_done = i == n or window[0] == left[n - i]
        right_done = j == len(right) or window[-1] == right[j - 1]
        if left_done and right_done:
            return left[:n - i] + window + right[j:]
        i, j = i if left_done else min(2 * i, n), j if right_done else min(2 * j, len(right))


def tree_tokens(ranks: Ranks, data: bytes, leaf: int = BYTES) -> tuple[bytes, ...]:
    """The tokens of some bytes, by halves."""
    if len(data) <= max(leaf, 1):
        return ranks.tokens(data)
    middle = len(data) // 2
    return join_tokens(ranks, tree_tokens(ranks, data[:middle], leaf), tree_tokens(ranks, data[middle:], leaf))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def join(find, left: list[str], right: list[str]) -> list[str]:
    """The matches of two neighbouring pieces as one text, from the matches of each."""
    if not left or not right:
        return left or right
    back, border = 0, len(left)
    while border and back < LOOK:  # a left match is settled when LOOK characters follow it
        border -= 1
        back += len(left[border])
    head = "".join(left[border:])
    taken, used = 0, 0  # of the right piece's matches, in the window
    want = _WINDOW
    while True:
        while taken < len(right) and used < want:
            used += len(right[taken])
            taken += 1
        window = find(head + "".join(right[:taken]))
        if taken == len(right):
            return left[:border] + window
        starts, at = {0: 0}, 0
        for i, match in enumerate(right[:taken]):
            at += len(match)
            starts[at] = i + 1
        end = 0
        for i, match in enumerate(window):
            end += len(match)
            if end + LOOK > len(head) + used:
                break
            after = starts.get(end - len(head))
            if after is not None:
                return left[:border] + window[:i + 1] + right[after:]
        want *= 4


def tree_matches(find, text: str, leaf: int = LEAF) -> list[str]:
    """The pattern's matches in a text, by halves."""
    if len(text) <= max(leaf, 1):
        return find(text)
    middle = len(text) // 2
    return join(find, tree_matches(find, text[:middle], leaf), tree_matches(find, text[middle:], leaf))


def encode(words: Vocabulary, text: str, leaf: int = LEAF) -> list[int]:
    """The ids of a text."""
    ids = words.ids
    return [i for match in tree_matches(words.matches, text, leaf) for i in ids(match)]


def decode(words: Vocabulary, ids: list[int]) -> bytes:
    """The bytes of ids, neighbours concatenated up the tree."""
    if len(ids) <= LEAF:
        bytes_of = words.bytes_of
        return b"".join([bytes_of[i] for i in ids])
    middle = len(ids) // 2
    return decode(words, ids[:middle]) + decode(words, ids[middle:])


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and `ids` (array of int) unless left out.

    A null text counts as empty and has no ids. Texts are read whole. Repeated rows, also with null ids, are encoded one by one. An
    empty table gives no rows. Other columns are not read. `path` names the rank file on every worker.
    """
    def encode_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path, pattern)
        names = words.names
        for frame in (whole.iloc[at:at + _ROWS] for whole in frames for at in range(0, len(whole), _ROWS)):
            out = []
            for value in frame["text"]:
                ids = encode(words, value or "", leaf)
                row = (len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decode(words, ids)).hexdigest())
                out.append((*row, np.array(ids, np.int32)) if with_ids else row)
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids], index=frame.index).assign(
                doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(encode_all, schema)
