"""Token counts that follow edits.

A document's text is cut into leaves of about LEAF characters, each a run of whole pre-tokens, under a segment tree
that sums the leaves' token counts.  Leaves meet only at *hard cuts*: a single space between two ASCII letters, before
which a pre-token always ends, whatever else the text holds; so leaf counts add up to the count of the whole text.
An edit re-encodes the leaves that it touches, and further ones on either side until both ends are hard cuts again,
and then updates the sums on the way to the root.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.session import extended

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 400
_HARD = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    return encoding_of(Path(path).read_bytes())


def leaves_of(text: str) -> list[str]:
    out, at = [], 0
    while True:
        cut = _HARD.search(text, at + LEAF) if at + LEAF < len(text) else None
        if cut is None:
            out.append(text[at:])
            return out
        out.append(text[at : cut.start()])
        at = cut.start()


class CountTree:
    """Leaves of a text, with segment trees of their characters and tokens."""

    def __init__(self, text: str, count):
        self.count = count
        self.leaves = leaves_of(text)
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(leaf), count(leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)
        self.encoded = 0  # characters that edits have encoded again

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, i: int, leaf: str, tokens: int) -> None:
        self.leaves[i] = leaf
        i += self.size
        self.chars[i], self.tokens[i] = len(leaf), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with characters, for the end), and its start."""
        i, start = 1, 0
        at = min(at, self.length - 1)
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _beyond(self, i: int, step: int) -> int | None:
        """The next leaf with characters before or after leaf ``i``."""
        i += step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Puts ``replacement`` in the place of characters ``start`` to ``end``; both are held within the text."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if not self.length:
            low = high = low_at = 0
            touched = ""
        else:
            low, low_at = self._find(start)
            high, _ = self._find(max(start, end - 1))
            touched = "".join(self.leaves[low : high + 1])
        touched = touched[: start - low_at] + replacement + touched[end - low_at :]
        while True:
            before, after = self._beyond(low, -1), self._beyond(high, 1)
            left = before is None or _HARD.match(self.leaves[before][-1:] + touched[:2], 1)
            right = after is None or _HARD.match(touched[-1:] + self.leaves[after][:2], 1)
            if left and right and touched:
                break
            if not left or (not touched and before is not None):
                low, touched = before, self.leaves[before] + touched
            elif not right or (not touched and after is not None):
                high, touched = after, touched + self.leaves[after]
            else:
                break
        self.encoded += len(touched)
        for i in range(low + 1, high + 1):
            if self.leaves[i]:
                self._set(i, "", 0)
        self._set(low, touched, self.count(touched))


_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_after", "n_edits", "n_chars_encoded_again")]


def _kernel(vocabulary: bytes, with_text: bool):
    def of(columns: list[pa.Array]) -> list[pa.Array]:
        encode = encoding_of(vocabulary).encode_ordinary
        rows, texts = [], []
        for text, edits in zip(columns[0], columns[1].to_pylist()):
            tree = CountTree(text.as_py() or "", lambda s: len(encode(s)))
            before = tree.total
            edits = [e for e in edits or () if e is not None and e["start"] is not None]
            for e in edits:
                tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["replacement"] or "")
            rows.append((before, tree.total, len(edits), tree.encoded))
            texts.append(tree.text() if with_text else None)
        made = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)]
        return made + ([pa.array(texts, pa.string())] if with_text else [])

    return of


def counted(docs: DataFrame, tokenizer: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """The columns of ``docs(text, edits)`` and ``n_tokens, n_tokens_after, n_edits, n_chars_encoded_again``.

    ``edits`` is an array of ``(start, end, replacement)`` in characters (code points), each applied to the text that
    the edits before it have left; ``with_text`` adds ``text_after``.

    - Null texts are empty (0 tokens); null edits, or edits with a null start, are left out; a null end is the start,
      a null replacement empty; places outside the text are moved to its ends, an end before the start to the start.
    - Texts without hard cuts are one leaf and are encoded again as a whole; results do not depend on the leaves.
    - Columns with the names of new ones are replaced; repeated rows each get their counts; no rows give no rows.

    ``tokenizer`` is the path of a ranks file on the driver, which travels with the tasks.  Rows stay where they are.
    """
    fields = _FIELDS + ([T.StructField("text_after", T.StringType())] if with_text else [])
    kind = "array<struct<start:int,end:int,replacement:string>>"
    return extended(docs, ["text", F.col("edits").cast(kind)], fields, _kernel(Path(tokenizer).read_bytes(), with_text))
