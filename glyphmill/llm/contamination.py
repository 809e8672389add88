"""Benchmark passages in documents, by a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item.  A document's words are streamed through it while the length of
the longest run that ends at each word is tracked; where it reaches a window's length, the words under it are hit.
Words outside the benchmark's vocabulary, found by vectorised hashes, reset the automaton, so only runs of vocabulary
words are walked one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import words as W
from glyphmill.llm.session import checkpointed, extended

WINDOW = 10
#: Words of items in one automaton (about 80 MB); a larger benchmark is cut into several, used one after another.
SHARD_WORDS = 100_000
#: Automata of one plan, which a task holds at the same time; then the findings so far are checkpointed.
PLAN_SHARDS = 4


class Automaton:
    """Suffix automaton of several sequences of integers, with the items at each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        ends: list[tuple[int, int]] = []
        for k, (_, sequence) in enumerate(items):
            last = 0
            for x in sequence:
                last = self._add(last, x, own)
                own[last].add(k)
            if 0 < len(sequence) < window:
                ends.append((k, len(sequence)))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: For each state whose longest run reaches the window: the ancestor that stands for its last ``window`` words.
        self.at_window = [-1] * len(self.next)
        items_at: dict[int, set[int]] = {}
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = self.at_window[up] if self.length[up] >= window else s
                items_at.setdefault(self.at_window[s], set()).update(own[s])
        self.items_at = {s: sorted(x) for s, x in items_at.items()}
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for k, n in ends:
            # The state of a whole short item, also where later items have split it.
            s = self._state_of(items[k][1])
            self.shorts.setdefault(s, []).append((n, k))
        #: The nearest state on the way to the root, itself included, where short items end.
        self.short_up = [-1] * len(self.next)
        for s in order:
            self.short_up[s] = s if s in self.shorts else self.short_up[self.link[s]] if self.link[s] > 0 else -1

    def _state_of(self, sequence: list[int]) -> int:
        s = 0
        for x in sequence:
            s = self.next[s][x]
        return s

    def _add(self, last: int, x: int, own: list[set[int]]) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, x, own)
        made = self._state(self.length[last] + 1, own)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = made
            p = self.link[p]
        if p < 0:
            self.link[made] = 0
        else:
            q = self.next[p][x]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, x, own)
        return made

    def _state(self, length: int, own: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        own.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, q: int, x: int, own: list[set[int]]) -> int:
        c = self._state(self.length[p] + 1, own)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Adds what a run of vocabulary words that begins at word ``at`` hits."""
        state = length = 0
        for k, x in enumerate(ids):
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.next[state]:
                state, length = self.next[state][x], length + 1
            if length >= self.window:
                end = at + k + 1
                spans.append((end - length, end))
                found.update(self.items_at[self.at_window[state]])
            s = self.short_up[state]
            while s > 0:
                for n, item in self.shorts[s]:
                    if n <= length:
                        spans.append((at + k + 1 - n, at + k + 1))
                        found.add(item)
                s = self.short_up[self.link[s]] if self.link[s] > 0 else -1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """An automaton over the hashes of normalised words."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        sequences = [(name, W.words(np.frombuffer(text.encode(), np.uint8), W.ALNUM).hashes) for name, text in rows]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s for _, s in sequences]]))
        self.automaton = Automaton([(name, np.searchsorted(self.vocabulary, s).tolist()) for name, s in sequences], window)
        sizes = [len(s) for _, s in sequences if len(s)]
        self.least = min([window, *sizes])

    def chunk(self, chunk: W.Chunk) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Word counts, hit word spans and item names of the chunk's documents."""
        found = W.words(chunk.text, W.ALNUM)
        at = np.searchsorted(found.starts, chunk.bounds)
        counts = np.diff(at)
        spans: list[list[tuple[int, int]]] = [[] for _ in counts]
        items: list[set[int]] = [set() for _ in counts]
        if len(self.vocabulary) and len(found.hashes):
            ids = np.searchsorted(self.vocabulary, found.hashes)
            ids[ids == len(self.vocabulary)] = 0
            known = self.vocabulary[ids] == found.hashes
            doc = np.repeat(np.arange(len(counts)), counts)
            begins = known & ~np.append(False, known[:-1] & (doc[1:] == doc[:-1]))
            stops = known & ~np.append(known[1:] & (doc[1:] == doc[:-1]), False)
            for a, b in zip(np.flatnonzero(begins), np.flatnonzero(stops) + 1):
                if b - a >= self.least:
                    d = doc[a]
                    self.automaton.walk(ids[a:b].tolist(), int(a - at[d]), spans[d], items[d])
        names = self.automaton.names
        return counts, [merged(s) for s in spans], [{names[i] for i in x} for x in items]


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _kernel(matcher: Matcher):
    def of(columns: list[pa.Array]) -> list[pa.Array]:
        counts, spans, items = [], [], []
        for chunk in W.chunks(columns[0]):
            n, s, i = matcher.chunk(chunk)
            counts.append(n)
            spans += s
            items += i
        if len(columns) > 1:  # what other automata have found
            spans = [merged([*s, *zip(x[0::2], x[1::2])]) for s, x in zip(spans, columns[1].to_pylist())]
            items = [s | set(x) for s, x in zip(items, columns[2].to_pylist())]
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.array([[x for span in s for x in span] for s in spans], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return of


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``item_id, text`` of the items that take part, and how many automata they need."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-total // (4 * SHARD_WORDS)))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` and ``n_words, hit_words, hit_items``, which replace columns of these names.

    Words are lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII.  A window is ``window``
    consecutive words of an item of ``benchmark(item_id, text)``; an item of fewer words, but not none, is one window.
    ``hit_words`` is a flat list start, end, start, end ... of the merged word spans that lie in occurrences of
    windows, ``hit_items`` the sorted item_ids (as strings) with windows that occur.

    - Null and empty texts have no words, on either side.  Items with a null item_id take no part.
    - Items that share an id, or a window, all count; each id is given once.
    - An empty benchmark hits nothing; an empty ``docs`` gives no rows.
    - Long texts are streamed whole.  Rows stay where they are; repeated rows each get their result.

    The automaton is broadcast; its size is bounded by SHARD_WORDS, beyond which the benchmark is cut by item into
    several automata that are passed one after another, PLAN_SHARDS of them in one plan.  No item may be larger than an executor's memory.
    """
    items, shards = _items(benchmark)
    out = docs
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).collect() if shards > 1 else items.collect()
        matcher = Matcher([(r.item_id, r.text) for r in rows], window)
        more = [F.col("hit_words"), F.col("hit_items")] if shard else []
        out = extended(out, ["text", *more], _FIELDS, _kernel(matcher))
        if shard % PLAN_SHARDS == PLAN_SHARDS - 1 and shard < shards - 1:
            out = checkpointed(out)
    return out


def _without(text: str | None, spans: list[int]) -> str | None:
    """``text`` without its word spans, given as a flat list of starts and ends."""
    if not spans:
        return text
    raw = text.encode()
    found = W.words(np.frombuffer(raw, np.uint8), W.ALNUM)
    parts, at = [], 0
    for a, b in zip(spans[0::2], spans[1::2]):
        parts.append(raw[at : int(found.starts[a])])
        at = int(found.ends[b - 1])
    return b"".join([*parts, raw[at:]]).decode()


def _cut(most_words: int, most_share: float, matcher: Matcher | None = None):
    """Texts without their hit spans, and whether a document stays; hits are found here, or come with the columns."""

    def of(columns: list[pa.Array]) -> list[pa.Array]:
        counts, spans, *_ = _kernel(matcher)(columns[:1]) if matcher else (columns[2], columns[1])
        texts, stay = [], []
        for text, n, found in zip(columns[0], counts.to_pylist(), spans.to_pylist()):
            hit = sum(found[1::2]) - sum(found[0::2])
            stay.append(hit <= min(most_words, most_share * n))
            texts.append(_without(text.as_py(), found) if stay[-1] else None)
        return [pa.array(texts, pa.string()), pa.array(stay, pa.bool_())]

    return of


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 1000, most_share: float = 0.5) -> DataFrame:
    """The columns of ``docs``, with hit spans cut out of ``text``.

    A document goes as a whole if more than ``most_share`` of its words, or more than ``most_words`` of them, are hit.
    Others lose the hit spans (from the first word's start to the last word's end) and keep every other byte; what
    hits nothing is unchanged.  Documents without words stay.  Other columns come along, whatever their names.

    A benchmark that fits one automaton is found and cut in one kernel, a larger one in several steps.
    """
    others = [c for c in docs.columns if c.lower() != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<_:int>")
    packed = docs.select(F.col("text").cast("string").alias("text"), row.alias("_row"))  # own names can't clash
    fields = [T.StructField("text", T.StringType()), T.StructField("_stay", T.BooleanType())]
    items, shards = _items(benchmark)
    if shards == 1:
        cut = extended(packed, ["text"], fields, _cut(most_words, most_share, Matcher([tuple(r) for r in items.collect()], window)))
    else:
        cut = extended(contaminated(packed, benchmark, window), ["text", F.col("hit_words"), F.col("n_words")], fields, _cut(most_words, most_share))
    return cut.where("_stay").select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def n_hit():
    """Words under ``hit_words``."""
    return F.aggregate(F.transform("hit_words", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
