"""Token counts by the public tokenizers' files; the path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into the pieces inside which pairs merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts tokens; pairs never merge across pieces, so the count of a piece is remembered."""

    def __init__(self, path: str = DEFAULT_TOKENIZER, forget_at: int = 500_000) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.findall = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}
        self.forget_at = forget_at

    def _learn(self, piece: str) -> int:
        if len(self.known) >= self.forget_at:
            self.known.clear()
        n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for p in self.findall(text):
            n = known.get(p)
            total += self._learn(p) if n is None else n
        return total


@lru_cache(maxsize=2)
def counter(path: str = DEFAULT_TOKENIZER) -> TokenCounter:
    """The worker's counter for a file."""
    return TokenCounter(path)
