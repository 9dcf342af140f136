"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads tokens. It begins as one state with a loop for every byte and accepts every byte string.
Each merge (u, v) -> uv, in order of rank, adds a gadget: the state that u leads to is copied without its
v-arc, all u-arcs move to the copy, and wherever u could be read uv can be read too, leading where v
led. What is left accepts exactly the canonical BPE token sequences, one for each byte string.

Composed with the tokens' spelling and made deterministic it reads bytes: a state of the transducer is where the canonical path
of what was read stands, and what longer tokens may still become of it. Every transition is annotated with
the last token of that path and with how the number of its tokens changes. The table of transitions is filled in as texts need
them and read for many words at once, a byte of each at a time; a word's tokens are then the last token, the one that ends
where it begins, and so on. Decoding emits the arcs' labels, the tokens' bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.cluster import ship
from quillstone.llm import pretokens
from quillstone.llm.common import lists, pieces

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MOST_STATES = 150_000  # of a worker's table; then it begins anew
FEW = 48  # tokens below a node of the spelling that are told apart one by one
SLICE = 2 << 20  # bytes of text that are read side by side: bounds memory
SCALAR = 24  # so few words that are this long are walked one by one


@cache
def _byte_of() -> dict[str, int]:
    """The printable alphabet in which byte-level vocabularies are written."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids of tokens and merges in order, from a tokenizer's JSON or a file of ranks (.tiktoken)."""
    if path.endswith(".tiktoken"):
        import base64

        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return ids, _merges_of(ids)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    raw = _byte_of()
    spell = lambda s: bytes(raw[c] for c in s)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {"".join(m) for m in merges}
    ids = {spell(t): i for t, i in model["vocab"].items() if t in made or len(t) == 1 and t in raw}
    return ids, [(spell(a), spell(b)) for a, b in merges]


def _merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge behind each token: the last one made when its bytes are merged with lower ranks only."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class MergeAutomaton:
    """The compiled automaton. Tokens are ids; target[t]: the state that token t leads to, -1 for tokens that no merge makes."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(ids.values()) + 1
        if size > 1 << 20:
            raise ValueError(f"ids of tokens must be below {1 << 20}")  # they share a number with states
        self.label: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.label[i] = token
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size  # -1: a single byte
        self.target, self.pairs = [-1] * size, {}
        states = 1
        for token, i in ids.items():
            if len(token) == 1:
                self.target[i] = 0
        for k, (a, b) in enumerate(merges):
            u, v, uv = ids[a], ids[b], ids[a + b]
            if self.target[u] < 0 or self.target[v] < 0 or self.target[uv] >= 0 or not self.follows(u, v):
                continue  # the two tokens never meet, so the merge never happens
            self.pairs[u << 20 | v] = k
            after = self.target[v]
            self.target[u] = states  # the gadget: u's arcs move to a copy of its state without the arc v
            states += 1
            self.target[uv], self.left[uv], self.right[uv], self.made[uv] = after, u, v, k
        self.reads = [-1] * states  # a token that leads to each state; what may follow is the same behind all that do
        for t, state in enumerate(self.target):
            if state >= 0:
                self.reads[state] = t
        self._trie()

    def follows(self, u: int, v: int) -> bool:
        """Whether v may be read after u: no gadget made before both took the arc, on the way down u's last and v's first parts."""
        limit, made, pairs = 1 << 60, self.made, self.pairs
        while True:
            k = pairs.get(u << 20 | v)
            if k is not None and k < limit:
                return False
            i, j = made[u], made[v]
            if i < 0 and j < 0:
                return True
            if i > j:  # the later of the two is taken apart: only merges before it were possible
                limit, u = i, self.right[u]
            else:
                limit, v = j + 1, self.left[v]

    def _trie(self) -> None:
        """Bytes to tokens: node << 8 | byte -> node, and the token that ends at a node."""
        step: dict[int, int] = {}
        ends, nodes = {}, 1
        for i, token in enumerate(self.label):
            if token and self.target[i] >= 0:
                node = 0
                for b in token:
                    key = node << 8 | b
                    node = step.get(key, 0)
                    if not node:
                        node = step[key] = nodes
                        nodes += 1
                ends[node] = i
        self.step, self.ends = step, [ends.get(k, -1) for k in range(nodes)]

    def encode(self, word: bytes) -> list[int]:
        """A word's tokens."""
        return transducer(self).encode(np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]))[0].tolist()

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, tokens))


class Transducer:
    """Deterministic over bytes. The table is a hash of transitions: keys[slot] = state << 8 | byte; to, last and change are those of the slot."""

    def __init__(self, auto: MergeAutomaton, most: int = MOST_STATES):
        self.auto, self.most = auto, most
        self.sizes = np.fromiter(map(len, auto.label), dtype=np.int64, count=len(auto.label))
        self.below = self._tokens_below()
        self._reset()

    def _tokens_below(self) -> list[tuple[int, ...] | None]:
        """For each node of the spelling the tokens strictly under it; None where there are many."""
        up = [0] * len(self.auto.ends)
        for key, node in self.auto.step.items():
            up[node] = key >> 8
        below: list[list[int] | None] = [[] for _ in up]
        for node, token in enumerate(self.auto.ends):
            at = node
            while token >= 0 and at:
                at = up[at]
                if below[at] is not None:
                    below[at].append(token)
                    if len(below[at]) > FEW:
                        below[at] = None
        return [None if x is None else tuple(x) for x in below]

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {(-1,): 0}
        self.states: list[tuple] = [(-1,)]
        self.same: dict[int, int] = {}
        self.classes: dict[tuple, int] = {}
        self.used = 0
        self._room(1 << 16)

    def _room(self, size: int) -> None:
        self.keys, self.to, self.last, self.change = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.shift = np.uint64(64 - size.bit_length() + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys, to, last, change) -> None:
        mask = len(self.keys) - 1
        for key, slot, *values in zip(keys.tolist(), self._slot(keys).tolist(), to, last, change):
            while self.keys[slot] >= 0:
                slot = slot + 1 & mask
            self.keys[slot] = key
            self.to[slot], self.last[slot], self.change[slot] = values
            self.used += 1

    def _add(self, key: np.ndarray) -> None:
        """The transitions of these keys, which the table lacks."""
        if 2 * (self.used + len(key)) > len(self.keys):
            old = self.keys >= 0
            have = self.keys[old], self.to[old].tolist(), self.last[old].tolist(), self.change[old].tolist()
            self.used = 0
            self._room(len(self.keys) * 4)
            self._put(*have)
        self._put(key, *zip(*(self._make(k >> 8, k & 255) for k in key.tolist())))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slots of transitions; those that aren't there yet are made."""
        while True:
            slot, mask = self._slot(key), len(self.keys) - 1
            there = self.keys[slot]
            left = np.flatnonzero(there != key)
            lost = []
            while len(left):
                none = there[left] < 0
                lost.append(left[none])
                left = left[~none]
                slot[left] = slot[left] + 1 & mask
                there[left] = self.keys[slot[left]]
                left = left[there[left] != key[left]]
            lost = np.concatenate(lost) if lost else left
            if not len(lost):
                return slot
            self._add(np.unique(key[lost]))

    def _open(self, node: int, u: int) -> int:
        """What an arc still open behind token u can become: -2 for nothing, else a token that stands for all behind which it can become the same."""
        tokens = self.below[node]
        if not tokens:
            return -2 if tokens is not None else u
        key = node << 21 | u + 1
        known = self.same.get(key)
        if known is None:
            follows = self.auto.follows
            may = tokens if u < 0 else tuple(t for t in tokens if follows(u, t))
            known = self.same[key] = self.classes.setdefault((node, may), u) if may else -2
        return known

    def _make(self, state: int, byte: int) -> tuple[int, int, int]:
        """Next state, last token and change of the number of tokens of a transition."""
        step, ends, follows = self.auto.step.get, self.auto.ends, self.auto.follows
        here = self.states[state]
        open_, found = [], None
        for node, u, behind in ((0, here[0], 0), *here[1:]):
            node = step(node << 8 | byte)
            if node is None:
                continue
            token = ends[node]
            if found is None and token >= 0 and (u < 0 or follows(u, token)):
                found = token, behind + 1
            u = self._open(node, u)
            if u > -2:
                open_.append((node, u, behind))
        if found is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        token, change = found
        key = (self.auto.reads[self.auto.target[token]], *((node, u, behind - change) for node, u, behind in open_))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, token, change

    def _walk(self, stream: np.ndarray, starts: np.ndarray, ends: np.ndarray, each) -> None:
        """each(words, place, slots) for every byte of every word: places in step, words by falling length, so that those left are always the first."""
        if len(self.states) > self.most:
            self._reset()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        first, size = starts[order], size[order]
        state = np.zeros(len(order), dtype=np.int64)
        deep, k = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left"), 0
        while k < len(deep) and deep[k] > SCALAR:
            n = int(deep[k])
            slot = self._find(state[:n].astype(np.int64) << 8 | stream[first[:n] + k])
            each(order[:n], k, slot)
            state = self.to[slot]
            k += 1
        for w in range(int(deep[k]) if k < len(deep) else 0):  # a few long words: whole stretches at a time would be of little use
            at, slots = int(state[w]), []
            known, to = {}, []
            for b in stream[first[w] + k : first[w] + size[w]].tolist():
                key = at << 8 | b
                hit = known.get(key)
                if hit is None:
                    slot = int(self._find(np.array([key]))[0])
                    if len(self.keys) != known.get(-1):  # slots have moved
                        known.clear()
                        known[-1] = len(self.keys)
                    hit = known[key] = int(self.to[slot]), int(self.last[slot]), int(self.change[slot])
                at = hit[0]
                slots.append(hit)
                to.append(at)
            each(int(order[w]), k, slots)

    def counts(self, stream: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number of tokens."""
        total = np.zeros(len(starts), dtype=np.int64)

        def add(words, place, found) -> None:
            if isinstance(words, int):
                total[words] += sum(x[2] for x in found)
            else:
                total[words] += self.change[found]

        self._walk(stream, starts, ends, add)
        return total

    def encode(self, stream: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens of all words, and each word's number of them."""
        last, total = np.zeros(len(stream), dtype=np.int32), np.zeros(len(starts), dtype=np.int64)

        def note(words, place, found) -> None:
            if isinstance(words, int):
                at = starts[words] + place
                last[at : at + len(found)] = [x[1] for x in found]
                total[words] += sum(x[2] for x in found)
            else:
                last[starts[words] + place] = self.last[found]
                total[words] += self.change[found]

        self._walk(stream, starts, ends, note)
        out = np.zeros(int(total.sum()), dtype=np.int32)
        at, to, left = ends.copy(), np.cumsum(total), np.flatnonzero(ends > starts)
        while len(left):  # the last token, then the one that ends where it begins
            tokens = last[at[left] - 1]
            to[left] -= 1
            out[to[left]] = tokens
            at[left] -= self.sizes[tokens]
            left = left[at[left] > starts[left]]
        return out, total


def transducer(auto: MergeAutomaton) -> Transducer:
    made = getattr(auto, "table", None)
    if made is None:
        made = auto.table = Transducer(auto)
    return made


@cache
def automaton(path: str) -> MergeAutomaton:
    """Compiled once on the driver, and sent to the workers (`sent`)."""
    return MergeAutomaton(*load(path))


def sent(docs: DataFrame, path: str) -> Broadcast:
    """The compiled automaton for the workers: a few MB, whatever the data. What a worker adds to the table stays with it for its next tasks."""
    auto = automaton(path)
    table, auto.table = getattr(auto, "table", None), None
    try:
        return docs.sparkSession.sparkContext.broadcast(auto)
    finally:
        auto.table = table


def encode_texts(texts: list[str], auto: MergeAutomaton) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and each text's number of ids."""
    stream, starts, ends, per = pretokens.spans(texts)
    flat, each = transducer(auto).encode(stream, starts, ends)
    sums = np.concatenate([[0], np.cumsum(each)])
    at = np.cumsum(per)
    return flat, sums[at] - sums[at - per]


def spelt(flat: np.ndarray, auto: MergeAutomaton) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens one after another, and each token's number of them."""
    table = transducer(auto)
    if not hasattr(table, "labels"):
        table.labels, table.begins = np.frombuffer(b"".join(auto.label), dtype=np.uint8), np.cumsum(table.sizes) - table.sizes
    n = table.sizes[flat]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return table.labels[np.repeat(table.begins[flat], n) + inner], n


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, number of tokens, tokens, and whether decoding gives the text's bytes back.

    Null text: tokens and n_tokens are null, round_trip is null. Empty text: no tokens, round_trip true.
    Repeated rows and null ids are kept as they are; other columns are ignored. No shuffle: one pass, Arrow batches.
    """
    ship(docs.sparkSession)
    kind, compiled = docs.schema[id_col].dataType, sent(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=SLICE):
            given = batch.column(1).to_pylist()
            flat, sizes = encode_texts([t or "" for t in given], compiled.value)
            bytes_, n = spelt(flat, compiled.value)
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)]
            ok, at = [], 0
            for t, end in zip(given, ends.tolist()):
                ok.append(None if t is None else bytes_[at:end].tobytes() == t.encode("utf-8", "surrogatepass"))
                at = end
            absent = np.array([t is None for t in given])
            tokens = lists(flat, sizes, pa.int32())
            if absent.any():
                tokens = pa.ListArray.from_arrays(tokens.offsets, tokens.values, mask=pa.array(absent))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, mask=absent, type=pa.int32()), tokens, pa.array(ok, type=pa.bool_())], ["id", "n_tokens", "tokens", "round_trip"])

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

    schema = StructType().add("id", kind).add("n_tokens", IntegerType()).add("tokens", ArrayType(IntegerType())).add("round_trip", BooleanType())
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Each row's id and the text that its tokens spell. Null tokens: null text; none: empty text. Bytes that aren't UTF-8 become U+FFFD; an id without a token raises.

    Repeated rows and null ids are kept as they are; an empty table gives an empty one; other columns, whatever they are called, are ignored.
    """
    ship(tokens.sparkSession)
    kind, compiled = tokens.schema[id_col].dataType, sent(tokens, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            auto = compiled.value
            texts = [None if t is None else auto.decode(t).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["id", "text"])

    from pyspark.sql.types import StringType, StructType

    picked = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tokens_col}`").cast("array<int>").alias("tokens"))
    return picked.mapInArrow(run, StructType().add("id", kind).add("text", StringType())).withColumnRenamed("id", id_col)
