"""Fast, exact use of public BPE vocabularies through the tokenizers library.

Both vocabularies split a text into pieces before merging, and merge each piece by itself. Texts of PLAIN characters
(ASCII, and letters of western languages that normal form C leaves alone) are cut into pieces here, by the vocabulary's
own pattern, and the library's model merges them. Pieces repeat; a worker keeps the packed ids of those it has seen in a
dictionary of bounded size. Other texts are cut into chunks at white space, over which no piece goes, and the library
encodes chunks that a worker has not seen.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: Keys in each of the two generations of a worker's memories.
PIECES = 400_000
CHUNKS = 100_000
#: White space, as Unicode has it and some more.
_ANY_SPACE = re.compile("[\\s\x1c-\x1f\x85\u180e\u2000-\u203f]")

# Fixed patterns of the two vocabularies, for PLAIN characters; what is most frequent stands first where order is free.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_SPACE = r"\t\n\x0b\x0c\r "
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
PLAIN = re.compile(rf"(?:[{_SPACE}!-;=-~{_LETTER}]++|<(?!\|))*+")  # special tokens, which the library finds in any text, begin with <|
WORD_PIECES = re.compile(rf"[{_LETTER}]++|[0-9]|{_ENDINGS}|[^{_SPACE}{_LETTER}0-9]++")
BYTE_PIECES = re.compile(rf" ?[{_LETTER}]++| ?[0-9]++|{_ENDINGS}| ?[^{_SPACE}{_LETTER}0-9]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_encoders: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; kind: word (white space is dropped) or byte (it is kept)."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path)
    return _encoders[path, kind]


def byte_symbols() -> dict[int, int]:
    """How byte-level vocabularies write each byte: visible Latin-1 characters as themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: 0x100 + i for i, b in enumerate(rest)}


_SYMBOLS = byte_symbols()


class Memory:
    """Values of keys, in two generations: when the young one is full it becomes the old one, and what is asked for
    again moves on, so frequent keys stay."""

    def __init__(self, size: int, make: Callable):
        self.size, self.make = size, make
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: list) -> list[bytes] | None:
        """The keys' values; None if some key has none."""
        values = list(map(self.young.get, keys))
        if None not in values:
            return values
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for i, v in enumerate(values):
            if v is None:
                k = keys[i]
                v = young.get(k)  # an earlier place among these keys
                if v is None:
                    v = old.get(k)
                    if v is None:
                        v = self.make(k)
                        if v is None:
                            return None
                    young[k] = v
                values[i] = v
        return values


class Encoder:
    pattern: re.Pattern

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.chunks, self.pieces = Memory(CHUNKS, self.of_chunk), Memory(PIECES, self.merged)

    def whole(self, text: str) -> bytes:
        """The library's whole path."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def merged(self, piece: str) -> bytes:
        """The ids of one piece, by the library's model."""
        lead, rest = ("\u0120", piece[1:]) if piece[0] == " " else ("", piece)  # what _SYMBOLS has for a space
        symbols = lead + rest if rest.isascii() and rest.isalnum() else piece.encode().decode("latin-1").translate(_SYMBOLS)
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.model.tokenize(symbols)])

    def normal(self, text: str) -> str:
        return text

    def of_chunk(self, key: bytes) -> bytes | None:
        """The ids that a chunk's key stands for; None if its text must be encoded whole."""
        raise NotImplementedError

    def keys(self, text: bytes) -> list[bytes]:
        """Keys of a text's chunks, whose ids, one after another, are those of the text, unless one of them has none."""
        raise NotImplementedError

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed as self.dtype."""
        out: list[bytes] = []
        for raw in texts:
            text = raw.decode()
            if PLAIN.fullmatch(text):
                values = self.pieces.of(self.pattern.findall(self.normal(text)))
            else:
                values = self.chunks.of(self.keys(raw))
            out.append(self.whole(text) if values is None else b"".join(values))
        return out


class WordEncoder(Encoder):
    """White space only separates, so chunks are what ASCII white space separates."""

    pattern = WORD_PIECES

    def normal(self, text: str) -> str:
        return text.lower()

    def of_chunk(self, key: bytes) -> bytes:
        return self.whole(key.decode())

    def keys(self, text: bytes) -> list[bytes]:
        return text.split()


class ByteEncoder(Encoder):
    """A chunk is a word with the space before it, or the first word of a line with the line break before it. Texts with
    other white space, or with white space at an end or next to more of it, are encoded whole: their keys show it.

    Keys: a word stands for itself after a space, one after U+000A for itself after that; the text's first word follows
    U+000D and has nothing before it."""

    pattern = BYTE_PIECES

    def of_chunk(self, key: bytes) -> bytes | None:
        text = key.decode()
        first, word = (text[0], text[1:]) if text[:1] in ("\r", "\n") else (" ", text)
        return None if not word or _ANY_SPACE.search(word) else self.whole(first.strip("\r") + word)

    def keys(self, text: bytes) -> list[bytes]:
        if b"\r" in text:
            return [b""]
        return (b"\r" + text).replace(b"\n", b" \n").split(b" ") if text else []
