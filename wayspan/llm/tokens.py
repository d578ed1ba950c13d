"""Token counts by a linear longest-match automaton.

Greedy word-piece: a word is cut, from its start, into the longest pieces of a
vocabulary. The vocabulary's trie has at each node a failure link (where matching goes
on after the greedy pieces of the node's string are popped) and the number of pieces so
popped, both computed once; a word's count is then the pops on one pass over its bytes,
without building pieces. The trie is a double array, stepped over all distinct words of
a slice of texts at once.

Pieces are bytes; a piece that starts a word begins with a space, any other continues
one. So ``read_pieces`` takes a rank file of byte-level pieces as it is, and a list with
``##`` marks. A word that can't be cut whole counts as one unknown token.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WHITE, with_text_columns

#: The vocabulary of the registered query; any other path may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The session's setting that names another one.
SETTING = "spark.wayspan.vocabulary"
#: A vocabulary is broadcast; more pieces than this are refused (public ones have up to some 250,000).
MOST_PIECES = 2_000_000
#: Words that are still stepped together; fewer are finished one by one.
FEW = 24


def read_pieces(path: str) -> list[bytes]:
    """A rank file (base64 piece, rank), read on the driver, or one piece a line with ``##`` before continuations."""
    with open(path, "rb") as lines:
        rows = [x.rstrip(b"\r\n") for x in lines if x.strip()]
    if path.endswith(".tiktoken"):
        return [base64.b64decode(x.split()[0]) for x in rows]
    return [x[2:] if x.startswith(b"##") and len(x) > 2 else b" " + x for x in rows]


class PieceAutomaton:
    """``base``, ``check``: double array of the trie; ``fail``, ``pops``: by node (fail -1: none)."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = {0: False}
        for n, piece in enumerate(set(pieces), 1):
            if n > MOST_PIECES:
                raise ValueError(f"more than {MOST_PIECES} pieces")
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    ends[len(children)] = False
                    children.append({})
                node = children[node][byte]
            ends[node] = node != 0
        fail, pops = self._links(children, ends)
        self.base, self.check, at = self._packed(children)
        self.fail, self.pops = np.full(len(self.check), -1, dtype=np.int32), np.zeros(len(self.check), dtype=np.int32)
        for node, slot in enumerate(at):
            self.fail[slot] = -1 if fail[node] < 0 else at[fail[node]]
            self.pops[slot] = pops[node]

    @staticmethod
    def _links(children: list[dict[int, int]], ends: dict[int, bool]) -> tuple[list[int], list[int]]:
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node].items():
                queue.append(child)
                if ends[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                back, popped = fail[node], pops[node]
                while back >= 0 and byte not in children[back]:
                    popped += pops[back]
                    back = fail[back]
                if back >= 0:
                    fail[child], pops[child] = children[back][byte], popped
        return fail, pops

    @staticmethod
    def _packed(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Slots of nodes such that node n goes by byte b to slot base[n] + b, owned by n."""
        at = [0] * len(children)
        base, check = {0: 0}, {0: -1}
        hint = [1] * 257  # where a node of so many children is tried first; passed gaps go to smaller nodes
        queue = deque([0])
        while queue:
            node = queue.popleft()
            held = sorted(children[node])
            if not held:
                continue
            first = hint[len(held)]
            while first in check or any(first - held[0] + b in check for b in held):
                first += 1
            hint[len(held)] = first
            start = base[at[node]] = first - held[0]
            for b in held:
                check[start + b] = at[node]
                at[children[node][b]] = start + b
                queue.append(children[node][b])
        size = max([*check, *(x + 256 for x in base.values())]) + 257
        bases, checks = np.zeros(size, dtype=np.int32), np.full(size, -2, dtype=np.int32)
        bases[list(base)] = list(base.values())
        checks[list(check)] = list(check.values())
        return bases, checks, at

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; all words are stepped together, byte by byte."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        sizes = sizes[order]
        state = np.zeros(len(words), dtype=np.int64)
        count = np.zeros(len(words), dtype=np.int64)
        self._step(state, count, np.arange(len(words)), np.full(len(words), 32))
        active = len(words)
        for i in range(int(sizes[0])):
            while active and sizes[active - 1] <= i:
                active -= 1
            if active < FEW:  # a very long word's bytes cost a plain step each
                for row in range(active):
                    state[row], count[row] = self._run(int(state[row]), int(count[row]), text[starts[row] + i : starts[row] + sizes[row]].tobytes())
                break
            self._step(state, count, np.arange(active), text[starts[:active] + i].astype(np.int64))
        while True:  # what is left of each word pops down to the root
            left = np.flatnonzero(state > 0)
            if not len(left):
                break
            count[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
        count[state < 0] = 1
        out = np.empty(len(words), dtype=np.int64)
        out[order] = count
        return out

    def _run(self, state: int, count: int, rest: bytes) -> tuple[int, int]:
        """One word from its state over the rest of its bytes."""
        base, check, fail, pops = (memoryview(x) for x in (self.base, self.check, self.fail, self.pops))
        for byte in rest:
            while state >= 0:
                to = base[state] + byte
                if to >= 0 and check[to] == state:
                    state = to
                    break
                count += pops[state]
                state = fail[state]
            if state < 0:
                break
        return state, count

    def _step(self, state: np.ndarray, count: np.ndarray, rows: np.ndarray, byte: np.ndarray) -> None:
        alive = state[rows] >= 0
        rows, byte = rows[alive], byte[alive]
        while len(rows):
            now = state[rows]
            to = np.maximum(self.base[now] + byte, 0)
            met = self.check[to] == now
            state[rows[met]] = to[met]
            rows, byte, now = rows[~met], byte[~met], now[~met]
            count[rows] += self.pops[now]
            state[rows] = self.fail[now]
            lost = state[rows] < 0
            rows, byte = rows[~lost], byte[~lost]


def count_texts(automaton: PieceAutomaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text; each distinct word of the slice is matched once."""
    split = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
    n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = pa.array([w for words in split for w in words], pa.binary())
    del split
    coded = pc.dictionary_encode(flat)
    each = automaton.counts(coded.dictionary.to_pylist())
    ends = np.cumsum(n_words)
    total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])]) if len(flat) else np.zeros(1, dtype=np.int64)
    return n_words, total[ends] - total[ends - n_words]


def token_counts(df: DataFrame, keep: list[str] | None = None, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns, n_words and n_tokens. Null, empty and blank texts: 0 and 0; rows stay as they are.

    ``vocabulary``: a path that the driver reads (else the one in the setting ``SETTING``, else ``VOCABULARY``).
    One mapInArrow over the scan, no shuffle. The automaton (a few MB, bounded by the
    vocabulary) is broadcast, so executors need no vocabulary file.
    """
    shared = df.sparkSession.sparkContext.broadcast(PieceAutomaton(read_pieces(vocabulary or df.sparkSession.conf.get(SETTING, VOCABULARY))))

    def setup():
        automaton = shared.value

        def columns(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(x, pa.int64()) for x in count_texts(automaton, texts.to_pylist())]

        return columns

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return with_text_columns(df, text_col, ["doc_id"] if keep is None else keep, fields, setup)


def plain_count(pieces: set[bytes], word: bytes, longest: int = 128) -> int:
    """The definition, for tests: cut off the longest piece (``longest`` bytes at most) again and again."""
    rest, n = b" " + word.strip(WHITE.encode()), 0
    while rest:
        size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n
