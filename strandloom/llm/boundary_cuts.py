"""Problem 10: splitting oversized texts at natural boundaries.

A sparse table of range maxima over the strength of the boundary at each token: the strongest cut in the permissible
window, the rightmost of equals, then a step back by the overlap.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..shared import spread
from .bpe import TOKENIZERS, VOCABULARY, Encoder, encoder

LIMIT, OVERLAP = 512, 32
#: A piece has at least this share of the limit, unless it is the text's last; the overlap may differ by SLACK tokens.
LEAST_SHARE, SLACK = 0.5, 4
#: Strengths: inside a character (never cut), inside a word, and so on to between paragraphs.
IN_CHARACTER, IN_WORD, BETWEEN_PIECES, BETWEEN_WORDS, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(-1, 7)
SENTENCE_ENDS, CLAUSE_ENDS, WIDE_ENDS = ".!?…", ",;:—–)", "。！？；，、："


def strengths(pieces: list[tuple[str, int]], token_bytes: list[int], raw: bytes) -> np.ndarray:
    """Strength of the boundary before token i, for i from 0 to the number of tokens (the ends count as paragraphs).

    ``pieces`` are the pieces of the text with their number of tokens.
    """
    ends = np.cumsum([0, *token_bytes])
    data = np.frombuffer(raw, np.uint8)
    inner = (data[ends[1:-1]] & 0xC0) != 0x80 if len(ends) > 2 else np.zeros(0, bool)
    out = np.full(len(ends), IN_CHARACTER, np.int64)
    out[1:-1] = np.where(inner, IN_WORD, IN_CHARACTER)
    out[0] = out[-1] = PARAGRAPH
    lines, mark = 0, ""  # the lines ended in the white space just before, and the character before that
    found = []
    known = _KNOWN.get
    for (piece, _), (after, _) in zip(pieces, pieces[1:]):
        if piece[-1].isspace():
            body = piece.rstrip()
            if body:
                mark, lines = body[-1], 0
            lines += piece[len(body) :].count("\n")
            found.append(_between(mark, lines, True, after))
        else:
            mark, lines = piece[-1], 0
            s = known((mark, after))
            if s is None:
                if len(_KNOWN) >= KNOWN_PAIRS:
                    _KNOWN.clear()
                s = _KNOWN[mark, after] = _between(mark, 0, False, after)
            found.append(s)
    if found:
        out[np.cumsum([n for _, n in pieces[:-1]])] = found
    return out


#: Strengths between a piece that ends in a character and the next piece, as kept by one Python worker.
_KNOWN: dict[tuple[str, str], int] = {}
KNOWN_PAIRS = 200_000


def _between(mark: str, lines: int, blank_before: bool, after: str) -> int:
    """Strength before the piece ``after``: ``mark`` is the last character that is not blank, ``lines`` the lines ended since."""
    blank_after = after[:1].isspace()
    space = blank_before or blank_after
    if not after.strip() and "\n" in after or blank_after and blank_before:
        return BETWEEN_PIECES  # the white space goes on: better cut at its end
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    if mark in WIDE_ENDS or mark in SENTENCE_ENDS and space:
        return SENTENCE if mark in "。！？" or mark in SENTENCE_ENDS else CLAUSE
    if mark in CLAUSE_ENDS and space:
        return CLAUSE
    if space:
        return BETWEEN_WORDS
    return IN_WORD if unicodedata.combining(after[0]) else BETWEEN_PIECES


class Strongest:
    """Sparse table: the position of the largest value in any range in constant time, the rightmost of equals."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n = n
        self.rows = [values.astype(np.int64) * n + np.arange(n)]  # larger value first, then further right
        width = 1
        while 2 * width <= n:
            below = self.rows[-1]
            self.rows.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def at(self, low: int, high: int) -> int:
        """Position of the strongest in low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        return int(max(self.rows[k][low], self.rows[k][high - (1 << k) + 1])) % self.n


def cuts(strength: np.ndarray, fits, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces. ``fits(start, end)`` tells by how many tokens the text of a range, encoded alone,
    exceeds the limit (0 if it fits); a range that does is cut shorter."""
    n, table, out, start = len(strength) - 1, Strongest(strength), [], 0
    while True:
        high, low = min(start + limit, n), start + max(overlap + SLACK + 1, int(limit * LEAST_SHARE))
        while True:
            end = n if n <= high else table.at(min(low, high), high)
            over = fits(start, end)
            if not over or end - start <= overlap + SLACK + 1:
                break
            high = min(high, end) - over
            low = min(low, high)
        out.append((start, end))
        if end == n:
            return out
        slack = min(SLACK, overlap)
        back = table.at(max(start + 1, end - overlap - slack), max(start + 1, end - overlap + slack)) if overlap else end
        start = back if strength[back] > IN_CHARACTER else end


def range_counter(starts: list[int], blank: list[bool], encoded, is_blank):
    """count(a, b): tokens of the text of a range of tokens, encoded alone.

    ``starts`` are the tokens at which the text's pieces begin, and the end; ``blank`` tells pieces of white space only;
    ``encoded(a, b)`` encodes the text of a range, ``is_blank(a, b)`` whether it is white space. Whole pieces keep their
    tokens wherever the text around them is cut, except that white space at a cut is taken together. So only what a
    cut touches is encoded again: a cut piece at the front with what follows up to a piece that is not blank (it may
    join that), a cut piece or blank ones at the back.
    """
    memo: dict[tuple[int, int], int] = {}

    def find(a: int, b: int) -> int:
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1  # the pieces of the first and the last token
        head, tail = i, j + 1  # pieces from head to before tail keep their tokens
        if starts[i] != a:
            head = i + 2
            while head <= j and blank[head - 1]:
                head += 1
        if starts[j + 1] != b or blank[j]:
            tail = j
            while tail > head and blank[tail - 1] and is_blank(starts[j], b):
                tail -= 1
        if head >= tail:
            return encoded(a, b)
        n = starts[tail] - starts[head]
        return n + (encoded(a, starts[head]) if starts[head] != a else 0) + (encoded(starts[tail], b) if starts[tail] != b else 0)

    def count(a: int, b: int) -> int:
        if (a, b) not in memo:
            memo[a, b] = find(a, b)
        return memo[a, b]

    return count


def pieces_of(text: str | None, e: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start_token, end_token, tokens of the piece encoded alone, its text); nothing for a text within the limit."""
    raw = (text or "").encode("utf-8")
    if len(raw) <= limit:  # a token has a byte or more
        return []
    parts = e.pieces(text)
    ids = list(chain.from_iterable([p for _, p in parts]))
    if len(ids) <= limit:
        return []
    size = list(map(e.length.__getitem__, ids))
    ends = np.cumsum([0, *size]).tolist()
    own = lambda a, b: raw[ends[a] : ends[b]].decode("utf-8")
    starts = np.cumsum([0, *[len(p) for _, p in parts]]).tolist()
    count = range_counter(starts, [p.isspace() for p, _ in parts], lambda a, b: len(e.encode(own(a, b))), lambda a, b: own(a, b).isspace())
    found = cuts(strengths([(p, len(i)) for p, i in parts], size, raw), lambda a, b: max(0, count(a, b) - limit), limit, overlap)
    return [(a, b, count(a, b), own(a, b)) for a, b in found]


def split_oversized(texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece_no, start_token, end_token, n_tokens, piece) of each text of more than ``limit`` tokens.

    Pieces have at most ``limit`` tokens, cover the text without a gap, and begin with the last ``overlap`` tokens (give
    or take SLACK) of the piece before. Null, empty and short texts give no rows.
    """
    if not 0 <= overlap < limit * LEAST_SHARE - SLACK - 1:
        raise ValueError("the overlap must be well under half the limit")
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, start_token int, end_token int, n_tokens int, piece string"

    def split(batches):
        import pyarrow as pa

        e = encoder(vocabulary, folder)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            shape = lambda o: pa.RecordBatch.from_arrays([pa.array(o[0], batch.column(key).type), *[pa.array(x, pa.int32()) for x in o[1:5]], pa.array(o[5], pa.string())], [key, "piece_no", "start_token", "end_token", "n_tokens", "piece"])
            for k, t in zip(batch.column(key), batch.column(text)):
                for i, (a, b, n, own) in enumerate(pieces_of(t.as_py(), e, limit, overlap)):
                    for x, v in zip(out, (k.as_py(), i, a, b, n, own)):
                        x.append(v)
                    held += len(own)
                if held > 4 << 20:
                    yield shape(out)
                    out, held = [[] for _ in range(6)], 0
            yield shape(out)

    return spread(texts.select(key, text)).mapInArrow(split, schema)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
