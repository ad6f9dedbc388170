"""BPE encoding by a deterministic tokenization automaton.

``Automaton`` is compiled from a merge list by one gadget per merge. The first
automaton has one state with a loop for each base symbol. The gadget of merge
``(u, v)`` takes the state ``r`` that ``u`` leads to: if ``r`` has an arc ``v``,
a copy of ``r`` without that arc becomes the target of ``u``, and every state
that has an arc ``u`` gets an arc ``uv`` to where ``v`` leads. Afterwards the
automaton accepts exactly one token path for each word, the one that applying
the merges in order gives.

All arcs with the same label lead to the same state, so the target is a table
by token. Copies share what they do not change: a state is its parent, the
token whose arc it lacks, and the number of the merge that made it. Arc tests
are compiled into a transition table as they are met; encoding a word walks
that table. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pretoken
from lodestone.llm.common import id_text

#: Words and chunks remembered by a worker, and transitions compiled at a time.
CACHE_WORDS, CACHE_ARCS = 250_000, 2_000_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: bytes that print as themselves in
    Latin-1 stay, the others follow from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(later)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for text, token in vocab.items():
            self.label[token] = text
        self.target = [0] * size  # the state that arcs with this label lead to
        self.parent, self.lacks, self.made = [-1], [-1], [-1]
        self.left = [-1] * size  # the first half of a merged token
        self.born = [-1] * size
        self.usable = [False] * size
        for symbol in byte_symbols():
            for text in (symbol, symbol + end):
                if text in vocab:
                    self.usable[vocab[text]] = True
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.longest = max((len(x.removesuffix(end)) for x in vocab), default=1)
        self._compile()

    def _compile(self) -> None:
        """Tables for encoding. Of the states that lack an arc for one token,
        none descends from another, so in the order of a walk over the tree of
        copies their descendants are disjoint intervals."""
        n = len(self.parent)
        size = [1] * n
        for state in range(n - 1, 0, -1):  # copies come after what they copy
            size[self.parent[state]] += size[state]
        enter, free = [0] * n, [1] * n
        for state in range(1, n):
            up = self.parent[state]
            enter[state] = enter[up] + free[up]
            free[up] += size[state]
        self._enter = enter
        self._without: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for state in sorted(range(1, n), key=enter.__getitem__):
            starts, stops, made = self._without.setdefault(self.lacks[state], ([], [], []))
            starts.append(enter[state])
            stops.append(enter[state] + size[state])
            made.append(self.made[state])
        self._arcs: dict[int, bool] = {}
        # By its first three symbols, how long a token can be.
        self._reach: dict[str, int] = {}
        for text, token in self.vocab.items():
            if self.usable[token] and not text.endswith(self.end):
                self._reach[text[:3]] = max(self._reach.get(text[:3], 0), len(text))

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        r = self.target[u]
        if not (self.usable[u] and self.usable[v] and self._has(r, v)) or self.born[uv] >= 0:
            return
        self.left[uv], self.born[uv], self.usable[uv] = u, rank, True
        self.target[uv] = self.target[v]
        self.parent.append(r)
        self.lacks.append(v)
        self.made.append(rank)
        self.target[u] = len(self.parent) - 1

    def _has(self, state: int, token: int) -> bool:
        """Does the state have an arc with this label? It has one for a merged
        token if it had one for the first half when the merge came."""
        until, limits = _NEVER, {}
        while token >= 0:
            limits[token] = until
            until, token = self.born[token], self.left[token]
        while state > 0:
            if (made := limits.get(self.lacks[state])) is not None and self.made[state] <= made:
                return False
            state = self.parent[state]
        return True

    def _arc(self, state: int, token: int) -> bool:
        """``_has`` by the compiled intervals."""
        at, until = self._enter[state], _NEVER
        while token >= 0:
            if (lists := self._without.get(token)) is not None:
                k = bisect_right(lists[0], at) - 1
                if k >= 0 and at < lists[1][k] and lists[2][k] <= until:
                    return False
            until, token = self.born[token], self.left[token]
        return True

    def step(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= CACHE_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._arc(state, token)
        return known

    def encode(self, symbols: str) -> list[int]:
        """The accepted path for one word, given as byte symbols: by the longest
        label that has an arc, and only where that ends nowhere by search."""
        n, at, state, path = len(symbols), 0, 0, []
        get, usable, arcs, reach, target = self.vocab.get, self.usable, self._arcs.get, self._reach.get, self.target
        while at < n:
            token = get(symbols[at:] + self.end) if n - at <= self.longest else None
            stop = n
            while token is None or not usable[token] or not (arcs(state << 20 | token) or self.step(state, token)):
                stop = min(n - 1, at + max(2, reach(symbols[at : at + 3], 0))) if stop == n else stop - 1
                if stop <= at:
                    return self._search(symbols)
                token = get(symbols[at:stop])
            path.append(token)
            at, state = stop, target[token]
        return path

    def _search(self, symbols: str) -> list[int]:
        """The accepted path, by going back from dead ends. From a dead end
        nothing is tried twice."""
        n, get, usable, end, target = len(symbols), self.vocab.get, self.usable, self.end, self.target
        path: list[tuple[int, int, int]] = []  # where each token starts, its state there, the token
        at, state, stop, dead = 0, 0, n, set()
        while at < n:
            found = -1
            limit = at + max(2, self._reach.get(symbols[at : at + 3], 0))
            while stop > at:
                if stop == n:
                    token = get(symbols[at:] + end) if n - at <= self.longest else None
                    after = min(n - 1, limit)
                else:
                    token, after = get(symbols[at:stop]), stop - 1
                if token is not None and usable[token] and self.step(state, token) and (stop, target[token]) not in dead:
                    found = token
                    break
                stop = after
            if found >= 0:
                path.append((at, state, found))
                at, state, stop = stop, target[found], n
                continue
            dead.add((at, state))
            if not path:
                raise ValueError(f"no token path for {symbols[:80]!r}")
            stop = at  # the token before ended here: go on with shorter ones
            at, state, _ = path.pop()
            stop = min(n - 1, at + max(2, self._reach.get(symbols[at : at + 3], 0))) if stop == n else stop - 1
        return [token for _, _, token in path]


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Whole texts to ids and back, through the automaton."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {**dict(enumerate(self.automaton.label)), **{i: s for s, i in self.special.items()}}
        self._symbol = byte_symbols()
        self._word = pretoken.Cache(self._encode_word, cache_words)
        self._chunk = pretoken.Cache(self._encode_chunk, cache_words)

    def _encode_word(self, word: str) -> list[int]:
        return self.automaton.encode("".join([self._symbol[b] for b in word.encode()]))

    def _encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for w in pretoken.words(chunk) for i in self._word[w]]
        return _packed(ids), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        found: list[tuple[bytes, str]] = []
        for k, piece in enumerate(pretoken.split_special(text)):
            if k % 2:
                found.append((_packed([self.special[piece]]), piece))
            else:
                found += map(self._chunk.__getitem__, pretoken.chunks(piece))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process: compiling takes part of a second."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary, decoded string)``, one row per input row.

    ``ids`` are little-endian unsigned 32-bit integers. ``tokenizer`` is the
    path of the tokenizer's file, present on every machine. Null and empty
    texts give no ids and an empty string. Rows are independent of each other:
    repeated rows, null ids and an empty table pass through.
    """

    def run(batches):
        tool = encoder(tokenizer)
        for batch in batches:
            done = [tool.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["doc_id", "ids", "decoded"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encode_decode``."""
    full = encode_decode(docs, tokenizer, id_col, text_col)
    return full.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
