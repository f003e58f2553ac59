"""Token ids of whole texts, by the tokenizers library.

Byte-level BPE never merges across a single space that stands between two other characters, so a text may be
cut before every such space, and equal pieces have equal ids wherever they stand. A piece of plain letters,
digits and signs is cut further into the library's pre-tokens, which its BPE model encodes; the whole library
encodes any other piece. A text that is plain as a whole is cut into pre-tokens at once. Short pieces and pre-tokens seen in this worker are looked up in memories that are bounded by
bytes; what they have dropped is encoded again, which changes nothing but the time.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, and another one of pieces.
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of texts and ids that one memory of a worker holds, and what an entry takes besides them.
MEMORY_BYTES = 96 << 20
ENTRY_BYTES = 180
LONGEST = 64
ID = np.dtype("<u4")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space beside a space, in either order.
SPACE_BEFORE, SPACE_AFTER = re.compile(r" \s"), re.compile(r"[^\S ] ")
LONG_SPACE = re.compile(r"\s{1000}")
#: Pre-tokens of plain pieces: letters (ASCII and Latin-1), digits or signs, each with the space before it,
#: and single line breaks. No apostrophe, which starts pre-tokens of its own.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")
#: Fixed value: how a special string begins.
SPECIAL = "<|"


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: its own if that can be seen."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARACTERS = _byte_characters()


def pieces_of(text: str) -> list[str]:
    """The text cut at single spaces that stand between two characters which are not white space.

    Each piece but the first has lost the space before it.
    """
    parts = text.split(" ")
    if "" not in parts and not SPACE_BEFORE.search(text) and not SPACE_AFTER.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Known(dict):
    """Ids by text, worked out when first asked for.

    At most ``room`` bytes are held, in two generations: when the younger one fills its half, the older one is
    dropped, so texts that keep coming stay. Texts of more than ``LONGEST`` characters are never kept.
    """

    def __init__(self, encode, room: int = MEMORY_BYTES):
        self.encode, self.room, self.held, self.older = encode, room // 2, 0, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= LONGEST:
            self.held += ENTRY_BYTES + len(text) + len(ids)
            if self.held > self.room:
                self.older, self.held = dict(self), 0
                self.clear()
            self[text] = ids
        return ids


def _is_plain(text: str, parts: list[str]) -> bool:
    """Whether the parts that PLAIN finds are the whole text and the library's own pre-tokens."""
    return sum(map(len, parts)) == len(text) and SPECIAL not in text and "\n\n" not in text


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``width`` bytes (2 or 4)."""

    def __init__(self, path: str, width: int = ID.itemsize):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        letter = {2: "H", 4: "I"}[width]
        self.packs = [struct.Struct(f"<{n}{letter}").pack for n in range(LONGEST)]
        self.dtype = np.dtype(f"<u{width}")
        self.pre_tokens = Known(self._pre_token)
        self.later = Known(lambda piece: self.piece(" " + piece))

    def packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < LONGEST else np.array(ids, self.dtype).tobytes()

    def _pre_token(self, text: str) -> bytes:
        written = text if text.isascii() else text.encode().decode("latin-1")
        return self.packed([t.id for t in self.tokenize(written.translate(BYTE_CHARACTERS))])

    def piece(self, text: str) -> bytes:
        """Ids of one piece, the space before it included."""
        parts = PLAIN.findall(text)
        if _is_plain(text, parts):
            return b"".join(map(self.pre_tokens.__getitem__, parts))
        return self.packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out, known, later = [], self.pre_tokens.__getitem__, self.later.__getitem__
        for text in texts:
            parts = PLAIN.findall(text)
            if _is_plain(text, parts):
                out.append(b"".join(map(known, parts)))
            else:
                pieces = pieces_of(text)
                out.append(self.piece(pieces[0]) + b"".join(map(later, pieces[1:])))
        return out


class RankEncoder:
    """Ids of texts by the same byte-level vocabulary given as ranks; special strings are plain text.

    Texts with very long runs of white space, which its pattern cannot cut, go to the tokenizers library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )

    @cached_property
    def other(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary_path())
        library.encode_special_tokens = True
        return library

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            self.other.encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else self.library.encode_ordinary(t)
            for t in texts
        ]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        return sorted(self.ranks, key=self.ranks.__getitem__)


class PieceEncoder:
    """Ids of texts by a sentencepiece model, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its piece with spaces as such, or the byte that it stands for."""
        model, out = self.library, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            byte = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else None
            out.append(byte if byte is not None else piece.replace("\u2581", " ").encode())
        return out


@lru_cache(maxsize=2)
def encoder(path: str, width: int = ID.itemsize) -> Encoder:
    return Encoder(path, width)


@lru_cache(maxsize=1)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
