"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk`` characters is encoded at once. A longer one is encoded in
chunks that overlap; each encoding says at which character each token starts. Two
neighbours are spliced at an offset in their overlap where both have a token start and
that is proven stable; if there is none, the overlap is widened and the right chunk
encoded anew, back to the start of the left chunk if need be, which it then replaces.

Why an offset is stable: this pre-tokenizer never lets a token run from a character
that is no white space into white space, so a token starts at each white-space run; and
a run of one space or one line feed between two such characters is read the same
whatever stands before it. So all tokens from there on depend only on what follows. The
first and last character of a chunk never offer a cut. Memory is bounded by the chunk.

The counts are those of the tokenizers library. A plain text (ASCII, Latin letters) is
read by a second library from the same vocabulary's rank file, if that is given, as it
is some five times faster; a text with other characters or with anything like a special
string goes through the tokenizers library, which handles special strings as by default.

Defined cases: a null text counts as empty, and an empty text has no tokens. Repeated
rows are counted row by row. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import held

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Characters that only some engines take for white space; neither side of a cut.
_ODD = "\x1c\x1d\x1e\x1f᠎"
_STABLE = re.compile(rf"(?<=[^\s{_ODD}])[ \n](?=[^\s{_ODD}])")
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
#: Fixed value: the pre-tokenizer's pattern, as the vocabulary's documentation gives it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Counts and token starts of a text, by the tokenizer file at path."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.library, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for token, i in table.items():
                self.width[i] = len(token)

    def plain(self, text: str) -> bool:
        return self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def count(self, text: str) -> int:
        if self.plain(text):
            return len(self.fast.encode_ordinary(text))
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> np.ndarray:
        """The character at which each token starts; a token may start inside a character."""
        if not self.plain(text):
            pairs = self.library.encode(text, add_special_tokens=False).offsets
            return np.array([a for a, _ in pairs], dtype=np.int64)
        ends = np.cumsum(self.width[self.fast.encode_ordinary(text)])
        at = np.concatenate([[0], ends[:-1]])[: len(ends)]
        if text.isascii():
            return at
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return np.cumsum(lead)[at] - 1


def _cuts(text: str, starts: np.ndarray) -> set[int]:
    """Stable offsets at which a token starts."""
    return {m.start() for m in _STABLE.finditer(text)} & set(starts.tolist())


def count_tokens(text: str, own: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    if len(text) <= chunk:
        return own.count(text) if text else 0
    total, begin, end = 0, 0, chunk
    starts = own.starts(text[:end])
    cuts = _cuts(text[:end], starts)
    while end < len(text):
        width = overlap
        while True:
            start = max(begin, end - width)
            stop = min(len(text), start + max(chunk, 2 * width))
            later = own.starts(text[start:stop]) + start
            cuts_later = {x + start for x in _cuts(text[start:stop], later - start)}
            common = cuts & cuts_later
            if common or start == begin:
                break
            width *= 2
        if common:
            at = max(common)
            total += int(np.count_nonzero(starts < at))
            begin, starts = at, later[later >= at]
            cuts = {x for x in cuts_later if x > at}
        else:  # the left chunk has no cut in all of its length; the wider chunk replaces it
            starts, cuts = later, cuts_later
        end = stop
    return total + len(starts)


def token_count(text: Column, path: str, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of each text by the tokenizer file at path."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = held(("tokens", path, ranks), lambda: Encoder(path, ranks))
        return pa.array([count_tokens(x.as_py() or "", own, chunk, overlap) for x in texts], pa.int64())

    return count(text)
