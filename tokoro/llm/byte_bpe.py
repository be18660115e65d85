"""Byte-level BPE by backtracking over longest matches.

The ranks alone define the merges. A sequence of tokens is the one that merging gives iff
each adjacent pair is: merging the two tokens' bytes alone would not merge across their
border. So a pre-token is encoded left to right with the longest token at each place (an
Aho-Corasick automaton over the vocabulary, bytes mapped to Latin-1 characters, finds them
all in one pass); when a token isn't compatible with the one before it, a shorter prefix is
tried, and when none is left the search steps back. Places already known to be dead ends
are never entered again, so the work is linear in the length; compatibility of a pair is
memoised.

Defined results: null text is empty (0 tokens; hashes of the empty string); a very long
text, or one without any space, is encoded whole; what the pattern doesn't match gets no
tokens; repeated rows give a row each, equal texts equal values; an empty table no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tokoro.llm.common import WorkerCache, held_alone, id_and_text, map_arrow
from tokoro.llm.subwords import ByteLevelCutter, pack_ids

PAIRS = 300_000
#: Pre-tokens up to this length go through the cache; longer ones are seldom seen again.
CACHED = 64


class BacktrackBPE(ByteLevelCutter):
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        super().__init__(pattern)
        compiled = regex.compile(pattern)
        self.split = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.text = {r: t for t, r in self.rank.items()}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token, r)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.pairs = WorkerCache(self._compatible, PAIRS)

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.text[token]
            found = self.shorter[token] = next((self.rank[p] for n in range(len(text) - 1, 0, -1) if (p := text[:n]) in self.rank), -1)
        return found

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token of one byte, or one that no
        merge makes, is its own pair."""
        found = self.halves.get(token)
        if found is None:
            parts = list(self.text[token])
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
                if (parts[best] + parts[best + 1]) not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (token, token)
        return found

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the border between the two tokens alone. The tokens are
        taken apart, the later merge first, and at each step the tokens that then touch
        the border must not merge sooner than those merges took place. The test is that of the
        ``bpe`` crate (github.com/github/rust-gems, MIT licence)."""
        left, right = pair
        until = 1 << 60
        while True:
            joined = self.rank.get(self.text[left] + self.text[right])
            if joined is not None and joined < until:
                return False
            if left > right:
                until = left
                left = self._split(left)[1]
                if left == until:
                    until = right + 1
                    right = self._split(right)[0]
                    if right + 1 == until:
                        return True
            else:
                until = right + 1
                right = self._split(right)[0]
                if right + 1 == until:
                    until = left
                    left = self._split(left)[1]
                    if left == until:
                        return True

    def encode_pretoken(self, word: bytes) -> list[int]:
        text = word.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None and self._makes(whole):
            return [whole]
        n = len(text)
        longest = [-1] * n
        size = [0] * n
        for end, token in self.automaton.iter(text):
            length = len(self.text[token])
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = out[-1] if out else -1
            placed = False
            while token >= 0:
                end = at + len(self.text[token])
                if not dead[end] and (before < 0 or self.pairs[before, token]):
                    placed = True
                    break
                token = self._prefix(token)
            if placed:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                token = out.pop()
                at -= len(self.text[token])
                token = self._prefix(token)

    def _makes(self, token: int) -> bool:
        """Whether merging the bytes of a token gives the token itself."""
        text = self.text[token]
        return len(text) == 1 or self._split(token) != (token, token)

    def pretoken(self, word: str) -> bytes:
        return pack_ids(self.encode_pretoken(word.encode()))

    def whole(self, text: str) -> bytes:
        known = self.pretokens
        return b"".join([known[w] if len(w) <= CACHED else self.pretoken(w) for w in self.split(text)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def coder(path: str, pattern: str) -> BacktrackBPE:
    return held_alone(("coder", path, pattern), lambda: BacktrackBPE(load_ranks(path), pattern))


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, then its ids
    decoded."""

    def run(batches):
        bpe = coder(ranks, pattern)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                ids = bpe.ids(text)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
