"""Edit-aware token counts.

A document's pre-tokens are grouped into leaves, and sums of characters and tokens stand over them in a binary
tree.  An edit re-encodes only the leaves it touches and one leaf of context before them, on to the next old
leaf boundary at which the new pre-tokens fall into step with the old ones; sums on the path to the root follow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32
#: Pieces whose token counts a worker remembers, beyond which the memory is emptied, and the longest such piece.
MEMORY = 400_000
LONGEST = 64
EDITS = "array<struct<start:int,stop:int,text:string>>"


class Counter:
    """Token counts of pre-tokens under one vocabulary file."""

    def __init__(self, ranks: str = RANKS):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        if len(known) > MEMORY:
            known.clear()
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p)) if len(p) > 1 or not p.isascii() else 1
                if len(p) <= LONGEST:
                    known[p] = n
            out.append(n)
        return out


class TokenTree:
    """Segment tree over the leaves of one text."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded_chars = text, counter, 0
        pieces = counter.split(text)
        sizes, counts = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(counter.counts(pieces), np.int64)
        self._build(*self._leaves_of(sizes, counts))

    @staticmethod
    def _leaves_of(sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves that hold these pre-tokens."""
        at = np.arange(0, len(sizes), LEAF)
        return tuple(np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64) for x in (sizes, counts))

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """The sums over the given leaves."""
        self.leaves = max(1, 1 << max(0, len(chars) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.leaves, np.int64), np.zeros(2 * self.leaves, np.int64)
        self.chars[self.leaves : self.leaves + len(chars)] = chars
        self.tokens[self.leaves : self.leaves + len(chars)] = tokens
        level = self.leaves // 2
        while level:
            for sums in (self.chars, self.tokens):
                sums[level : 2 * level] = sums[2 * level : 4 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a position; the last non-empty leaf for the end of the text."""
        node, start = 1, 0
        position = min(position, int(self.chars[1]) - 1)
        while node < self.leaves:
            node *= 2
            if position >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.leaves, start

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        """Leaves first..last now hold `pieces`; where they are too many for them, leaves are put in and the sums built again without encoding."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars, tokens = self._leaves_of(sizes, np.array(self.counter.counts(pieces), np.int64))
        if len(chars) <= last - first + 1:
            for leaf in range(first, last + 1):
                k = leaf - first
                if k < len(chars):
                    self._put(leaf, int(chars[k]), int(tokens[k]))
                elif self.chars[self.leaves + leaf]:
                    self._put(leaf, 0, 0)
            return
        old = self.chars[self.leaves :], self.tokens[self.leaves :]
        whole = [np.concatenate([x[:first], new, x[last + 1 :]]) for x, new in zip(old, (chars, tokens))]
        filled = whole[0] > 0
        self._build(whole[0][filled], whole[1][filled])

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the code points start..stop-1 by `new`."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if not size:
            self.__init__(new, self.counter)
            self.encoded_chars += len(new)
            return
        # a pre-token may look at the characters after it: begin a leaf before, two for an edit in a leaf's first pre-tokens
        first, begin = self._leaf_at(max(0, start - 1))
        for _ in range(2):
            if begin:
                first, begin = self._leaf_at(begin - 1)
        delta = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        last, after = self._leaf_at(stop)
        bound = after + int(self.chars[self.leaves + last])  # end of the last touched leaf, in the old text
        pieces, at = [], begin
        for match in self.counter.finditer(text, begin):
            while at - delta > bound:
                last, after = self._leaf_at(bound)
                bound = after + int(self.chars[self.leaves + last])
            if at >= start + len(new) and at - delta == bound:
                break
            pieces.append(match.group())
            at = match.end()
        else:
            last, bound = self.leaves - 1, size
        self._replace(first, last, pieces)
        self.text = text
        self.encoded_chars += at - begin


def token_counts(
    docs: DataFrame, *, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits"
) -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, n_chars, edited_chars, encoded_chars) of every row of `docs` (doc_id, text, edits).

    edits: array of struct(start, stop, text) in code points of the text, not overlapping, made from the last
    to the first; null edits and null fields of them change nothing.  Null texts count as empty.
    encoded_chars: characters re-encoded for the edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        names = ["doc_id", "n_tokens", "edited_tokens", "n_chars", "edited_chars", "encoded_chars"]
        for batch in batches:
            counter = counter or Counter(ranks)
            out = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                tree = TokenTree(text, counter)
                before = tree.total
                for e in sorted((e for e in batch.column(2)[k].as_py() or [] if e and None not in e.values()), key=lambda e: -e["start"]):
                    tree.edit(e["start"], e["stop"], e["text"])
                out.append((before, tree.total, len(text), len(tree.text), tree.encoded_chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5))], names=names
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(edits_col).cast(EDITS).alias("edits")
    )
    return rows.mapInArrow(run, "doc_id long, n_tokens long, edited_tokens long, n_chars long, edited_chars long, encoded_chars long")
