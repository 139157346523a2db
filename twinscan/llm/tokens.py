"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


#: Code points whose class is the same in all Unicode versions in use: texts of others go to the tokenizer whole.
_SETTLED = [*range(0x530), *range(0x2000, 0x2C00), 0xFEFF]
MOST_PIECES = 200_000


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


@lru_cache(maxsize=1)
def _pieces() -> tuple[re.Pattern, re.Pattern]:
    """What SPLIT matches, and texts outside of the settled code points."""
    letters, numbers = (_ranges([p for p in _SETTLED if unicodedata.category(chr(p))[0] == c]) for c in "LN")
    blanks = r"\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
    whole = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    return re.compile(whole), re.compile(f"[^{_ranges(_SETTLED)}]")


class _Counts(dict):
    """Tokens of each piece met so far; a piece is one word with its blank, so most are met again."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(path)


def token_count(text: str | None, path: str = VOCABULARY) -> int:
    """Number of tokens; special-token strings in a text are ordinary text; null and empty have none.

    The tokenizer splits a text into pieces and encodes each by itself, so the counts of pieces are kept and added up.
    """
    if not text:
        return 0
    pieces, other = _pieces()
    if other.search(text):
        return len(encoding(path).encode_ordinary(text))
    return sum(map(_counts(path).__getitem__, pieces.findall(text)))
