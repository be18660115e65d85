"""Token ids of whole texts through the public tokenizer libraries, with worker caches.

Both vocabularies cut a text at places that don't depend on what stands further away, so a
text's ids are the ids of its chunks put together, and most chunks repeat. Each rule below
says where a cut is safe; a text that breaks the rule goes through the library whole.

Texts of ASCII and Latin letters alone take a shorter way. ``ByteBPE`` cuts them into the
vocabulary's own pre-tokens in one pass, so that one look-up gives a pre-token's ids, and
one call of the library those of a new one. ``WordBPE`` lower-cases them whole and cuts at
white space; pieces and the pre-tokens inside them share one cache.
"""

from __future__ import annotations

import functools
import re
import struct

from tokoro.llm.common import WorkerCache, held_alone

CHUNKS, PRETOKENS, PLAIN_PRETOKENS = 150_000, 150_000, 300_000
#: Characters of a text from which on its pre-tokens aren't held all at once.
LONG_TEXT = 1 << 20
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"

#: Marks that are a pre-token by themselves behind a word.
MARKS = b".,;:!?"
TEXT_MARKS = frozenset(MARKS.decode())
#: White space beyond ASCII (in UTF-8; the third also begins other punctuation).
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe2\x80", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
SPACE_AFTER_SPACE = (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ")
_TANGLED = re.compile(rb"[\t-\r ] [\t-\r ]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack_ids(ids) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def each_match(pattern: re.Pattern, text: str):
    """All matches of a pattern without groups, of a very long text one by one."""
    return pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(text))


def cut_at_spaces(text: bytes) -> list[bytes] | None:
    """Pieces of a text such that each later one begins with a space; None if a cut could
    fall inside a run of white space that the pattern sees as a whole."""
    if any(s in text for s in SPACE_AFTER_SPACE) and _TANGLED.search(text):
        return None
    if not text.isascii() and any(s in text for s in WIDE_SPACE):
        return None
    return text.split(b" ")


class WordBPE:
    """The lower-casing BPE with word ends. White space parts its pre-tokens and is
    dropped, so texts are cut at ASCII white space. ``ids(text)`` gives little-endian
    unsigned 32-bit ids."""

    PLAIN = re.compile(rf"[!-~{LATIN}]+")
    PLAIN_TEXT = re.compile(rf"[\t-\r -~{LATIN}]*")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PIECE = re.compile(r"\S+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.largest = max(self.library.get_vocab(with_added_tokens=True).values())
        self.letters = byte_letters()
        self.tokenize = self.library.model.tokenize
        self.pieces = WorkerCache(self._piece, PLAIN_PRETOKENS)  # of plain texts, lower-cased
        self.chunks = WorkerCache(self._chunk, CHUNKS)

    def _pretoken(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return pack_ids([t.id for t in self.tokenize(word)])

    def _piece(self, piece: str) -> bytes:
        # Most pieces seen for the first time are words, with or without a mark behind.
        if piece.isalpha() or len(piece) == 1:
            return self._pretoken(piece)
        if piece[:-1].isalpha() and piece[-1] in TEXT_MARKS:
            return self.pieces[piece[:-1]] + self.pieces[piece[-1]]
        parts = self.PARTS.findall(piece)
        return self._pretoken(piece) if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def _chunk(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        if not chunk.isalpha() and (not self.PLAIN.fullmatch(word) or "<|" in word):
            return pack_ids(self.library.encode(word, add_special_tokens=False).ids)
        return self.pieces[word.lower()]

    def ids(self, text: bytes) -> bytes:
        plain = text.decode()
        if self.PLAIN_TEXT.fullmatch(plain) and "<|" not in plain:
            plain = plain.lower()
            return b"".join(map(self.pieces.__getitem__, plain.split() if len(plain) < LONG_TEXT else each_match(self.PIECE, plain)))
        return b"".join(map(self.chunks.__getitem__, text.split()))


class ByteLevelCutter:
    """Whole texts to ids for a byte-level pattern. For the pattern that ``PARTS`` restates
    for plain texts (``KNOWN``), texts are cut at single spaces where that is safe, each
    piece through a cache; with any other pattern every text goes through ``whole``.
    ``whole`` and ``pretoken`` are the encoder's own."""

    PLAIN = re.compile(rf"[\t-\r -~{LATIN}]*")
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")

    #: The pattern of byte-level vocabularies (a fixed value).
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str):
        self.cuts = pattern == self.KNOWN
        self.pretokens = WorkerCache(self.pretoken, PRETOKENS)
        self.first = WorkerCache(self._chunk, CHUNKS // 8)
        self.chunks = WorkerCache(lambda piece: self._chunk(b" " + piece), CHUNKS)  # by what follows a space

    def pretoken(self, word: str) -> bytes:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def _chunk(self, chunk: bytes) -> bytes:
        word = chunk[1:] if chunk[:1] == b" " else chunk
        if word.isalpha():
            return self.pretokens[chunk.decode()]
        if word[:-1].isalpha() and word[-1] in MARKS:
            return self.pretokens[chunk[:-1].decode()] + self.pretokens[chr(chunk[-1])]
        text = chunk.decode()
        if not self.PLAIN.fullmatch(text) or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.pretokens.__getitem__, self.PARTS.findall(text)))

    def ids(self, text: bytes) -> bytes:
        pieces = cut_at_spaces(text) if self.cuts else None
        if pieces is None:
            return self.whole(text.decode())
        first = self.first[pieces[0]] if pieces[0] else b""
        return first + b"".join(map(self.chunks.__getitem__, pieces[1:]))


class ByteBPE(ByteLevelCutter):
    """The byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.tokenize = self.library.model.tokenize
        super().__init__(self.KNOWN)
        self.pretokens = WorkerCache(self.pretoken, PLAIN_PRETOKENS)

    def pretoken(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these the space alone has another letter
            mapped = word.replace(" ", self.letters[32])
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        return pack_ids([t.id for t in self.tokenize(mapped)])

    def ids(self, text: bytes) -> bytes:
        plain = text.decode()
        if self.PLAIN.fullmatch(plain) and "<|" not in plain:
            return b"".join(map(self.pretokens.__getitem__, each_match(self.PARTS, plain)))
        return super().ids(text)

    def whole(self, text: str) -> bytes:
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def byte_bpe(path: str) -> ByteBPE:
    return held_alone(("byte_bpe", path), lambda: ByteBPE(path))
