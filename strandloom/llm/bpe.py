"""Problem 8: exact byte-pair encoding of whole texts by dynamic programming over prefixes.

Of all token sequences that spell a piece of text, byte-pair encoding yields the one whose neighbouring tokens are all
compatible: the merges would not have joined or cut them otherwise. So every prefix of a piece has one last token: the
token that ends there and is compatible with the last token of the prefix before it. An automaton finds the tokens that
end at each byte; the last tokens are stored for every prefix and followed back from the end. Time is linear in the
length, also in stretches without any break, where merging pair by pair is not.
"""

from __future__ import annotations

import base64
import os

import numpy as np

#: How texts are split into pieces before merging; fixed value, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files are; a parameter of every function that reads them.
TOKENIZERS = os.environ.get("STRANDLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept with their ids in one Python worker, by number and by length of each.
MEMO_PIECES, MEMO_BYTES = 200_000, 64


class Encoder:
    """Exact encoder of one rank file. ``encode(text)`` gives the ids, ``pieces(text)`` also where pieces end."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.bytes = {r: t for t, r in ranks.items()}
        self.ranks = ranks
        self.length = [0] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.length[r] = len(t)
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._split_tokens()
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _split_tokens(self) -> None:
        """The pair whose merge makes each token: its own encoding by the tokens ranked before it has two parts."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.left[rank] = self.right[rank] = rank
            if len(token) < 2:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.left[rank], self.right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            self.joined[self.left[rank], self.right[rank]] = rank

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a boundary between tokens a and b: undo their merges from the last to the first; at
        no moment may the two symbols that touch merge before the next undone merge would have taken place."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # x and y are the symbols that touch; ``until`` bounds the ranks of merges that come before the one undone last,
        # ``after_tie`` tells that a merge of that very rank to the left of it comes first too.
        x, y, until = a, b, (1 << 40, 0)
        while True:
            merged = self.joined.get((x, y))
            if merged is not None and (merged, 1) < until:
                return False
            if self.left[x] == x and self.left[y] == y:
                return True
            # Of two merges of one rank the left one comes first, so the right one is undone first.
            if x > y and self.left[x] != x or self.left[y] == y:
                until, x = (x, 1), self.right[x]
            else:
                until, y = (y, 2), self.left[y]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, without the memo."""
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        last = [-1] * (len(raw) + 1)
        length, compatible = self.length, self.compatible
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def _ids(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.piece(piece)
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """All ids; none for null and empty text. Nothing in the text counts as a special token."""
        if not text:
            return []
        out: list[int] = []
        get, grow, ids = self.memo.get, out.extend, self._ids
        for p in self.find(text):
            grow(get(p) or ids(p))
        return out

    def pieces(self, text: str | None) -> list[tuple[str, list[int]]]:
        """(piece, its ids), in order."""
        get, ids = self.memo.get, self._ids
        return [(p, get(p) or ids(p)) for p in self.find(text or "")]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY, folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a rank file, built once in each Python worker."""
    path = os.path.join(folder, name)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ragged(values: list[list[int]]):
    """An Arrow list column from lists of ids."""
    import pyarrow as pa

    ends = np.cumsum([0] + [len(v) for v in values], dtype=np.int64)
    flat = np.fromiter((x for v in values for x in v), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
