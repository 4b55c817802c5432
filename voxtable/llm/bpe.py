"""Byte-pair encoding and decoding with a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts just the right tokenizations. It starts
with one state and an arc for every byte. The gadget of merge (u, v) -> w, taken in merge order, gives u's arcs a new
target, a copy of the old one without its arc v, and adds an arc w, to the target of v, wherever u and then v led on.
All arcs of one label share a target, so a gadget adds one state, and a state is stored as its parent and the arc it
lost. An arc's presence follows from that table: an arc lost by a state or a parent takes with it the arcs that later
merges built on it.

Encoding a pre-split word runs over its bytes once: at each place one token ends that the automaton allows after the
token before it, since every word has one right tokenization. Decoding emits the labels of the arcs.

Defined cases: null or empty text has no ids; strings of special tokens in a text become their ids; very long texts
are encoded whole; repeated rows are encoded each; null ids are passed on; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.arrow import slices, text_of

#: Fixed pattern of byte-level pre-splitting, white space written out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
CACHED_WORDS = 250_000
CACHED_ARCS = 1_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Tokens with their bytes, and the arcs between them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self._compile([tuple(vocab[x] for x in (*pair, pair[0] + pair[1])) for pair in map(_pair, model["merges"])])
        self._trie(set(vocab.values()) - set(self.special.values()))

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        n = len(self.labels)
        #: Of each state: the state it was copied from, the arc it lost, by which merge.
        self.parent, self.lost = [0], [(-1, NEVER)]
        #: The state that the arcs of a token lead to, now and when the token was made.
        target = [0] * n
        #: Token -> the (token, merge) before it on its left side: w stands on u's arc.
        self.stands_on: list[int] = [-1] * n
        self.made = [-1] * n
        self.dead: set[int] = set()
        #: (state's token u, lost arc v) -> merge; a state's losses are looked up through the tokens on its right side.
        self.merge_of: dict[int, int] = {}
        self.right = [-1] * n
        self.width = n
        for step, (u, v, w) in enumerate(merges):
            if self.made[w] >= 0:
                raise ValueError("two merges make the same token")
            if not self._arc(u, v):
                self.dead.add(w)
            self.stands_on[w], self.right[w], self.made[w] = u, v, step
            target[w] = target[v]
            self.parent.append(target[u])
            self.lost.append((v, step))
            target[u] = len(self.parent) - 1
            self.merge_of[u * n + v] = step
        self.target = target

    def _arc(self, a: int, b: int) -> bool:
        """Whether the state after a has an arc b: none of the arcs that b stands on was lost before it was made."""
        merge, n = self.merge_of, self.width
        r, until = a, NEVER
        while r >= 0:
            x, made = b, NEVER
            while x >= 0:
                step = merge.get(r * n + x)
                if step is not None and step < until and step <= made:
                    return False
                x, made = self.stands_on[x], self.made[x]
            r, until = self.right[r], self.made[r]
        return True

    def _trie(self, tokens: set[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t in sorted(tokens - self.dead):
            node = 0
            for byte in self.labels[t]:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = self.next[node][byte]
            self.token[node] = t
        self.arcs: dict[int, bool] = {}

    def word(self, data: bytes) -> list[int]:
        """The one accepted path that spells data."""
        n, step, token, arcs, width = len(data), self.next, self.token, self.arcs, self.width
        last = [-1] * (n + 1)
        for start in range(n):
            before, node = last[start] * width, 0
            for end in range(start, n):
                node = step[node].get(data[end])
                if node is None:
                    break
                t = token[node]
                if t < 0 or last[end + 1] >= 0:
                    continue
                if start:
                    allowed = arcs.get(before + t)
                    if allowed is None:
                        if len(arcs) >= CACHED_ARCS:
                            arcs.clear()
                        allowed = arcs[before + t] = self._arc(last[start], t)
                    if not allowed:
                        continue
                last[end + 1] = t
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= len(self.labels[last[at]])
        return ids[::-1]


def _pair(merge: str | list[str]) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


class Encoder(dict):
    """Pre-split words -> their ids as little-endian 32-bit integers; emptied when full."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        special = sorted(automaton.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda text: [text]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = np.array(self.automaton.word(word.encode()), "<u4").tobytes()
        return ids

    def text(self, text: str) -> bytes:
        out = []
        for part in self.marks(text):
            mark = self.automaton.special.get(part)
            out.append(b"".join(map(self.__getitem__, self.split(part))) if mark is None else np.array([mark], "<u4").tobytes())
        return b"".join(out)


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a tokenizers file, compiled once in each Python process."""
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens, ids (little-endian 32-bit). tokenizer: a path that executors can read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(automaton(tokenizer))
        for batch in slices(batches, "text"):
            ids = [encoder.text(t) for t in text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(fn, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id, n_tokens, ids and the decoded text. Bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = automaton(tokenizer).labels
        for batch in slices(batches, "ids"):
            texts = [b"".join(map(labels.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(fn, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col))
