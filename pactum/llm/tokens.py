"""Byte-level BPE ids of texts, by the tokenizers library.

The pre-tokenizer of such a vocabulary cuts a text by one pattern, and each piece
is encoded by itself. `Encoder` cuts with the same pattern and lets the library's
model encode each different piece once, keeping the ids of recent pieces; the ids are
those of `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np

from pactum.llm.common import kept

#: The pre-tokenizer pattern of the vocabulary, as its file's ByteLevel step with use_regex has it. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which BEYOND_LATIN finds nothing: the classes are written out and the
#: usual ones come first, which the standard module matches faster.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
LATIN_PATTERN = rf" [{_LETTERS}]+|[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
BEYOND_LATIN = rf"[^\t-\r -~{_LETTERS}]"
#: Pieces that a worker remembers at most, about, and their greatest length.
REMEMBERED, LONGEST_REMEMBERED = 800_000, 60
#: Characters that are cut at once, about. A longer text is cut in parts, where a piece is sure to begin.
CHARACTERS = 1 << 17


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: the printable ones as they are, the others as characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """The ids of pieces, as bytes. A piece that is not there is handed to the library's model, and remembered."""

    def __init__(self, model, code: str):
        self.tokenize, self.code, self.spelling = model.tokenize, code, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelt = piece.replace(" ", self.spelling[32])
        else:
            spelt = piece.encode("utf-8").decode("latin-1").translate(self.spelling)
        ids = array(self.code, [t.id for t in self.tokenize(spelt)]).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Drop the older half, when it is too much. What is in use soon comes back."""
        if len(self) > REMEMBERED:
            kept = dict(islice(self.items(), len(self) - REMEMBERED // 2, None))
            self.clear()
            self.update(kept)


class Encoder:
    """Encodes with a byte-level BPE vocabulary file. Any other kind of tokenizer file goes to the library whole."""

    def __init__(self, path: str, special: bool = True):
        """special: whether the strings of special tokens in a text become those tokens, as the library has it by default."""
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        step = config.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in config.get("added_tokens", [])] if special else []
        self.tokenizer.encode_special_tokens = not special
        self.by_piece = not config.get("normalizer") and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.cut_any, self.cut_latin, self.beyond_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall, re.compile(BEYOND_LATIN).search
        self.part_end = regex.compile(r"(?<=\S) (?=\p{L})").search
        self.pieces = Pieces(self.tokenizer.model, "H" if self.kind == "<u2" else "I")

    @classmethod
    def of(cls, path: str, special: bool = True) -> Encoder:
        """This process's encoder of a vocabulary file."""
        return kept((cls, path, special), lambda: cls(path, special))

    def cut(self, text: str) -> list[str]:
        return self.cut_any(text) if self.beyond_latin(text) else self.cut_latin(text)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def ids_of_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, of dtype `kind`; null has none."""
        return [self.ids(text) for text in texts]

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.by_piece or any(x in text for x in self.special):
            return self._whole(text)
        parts = self._parts(text) if len(text) > 2 * CHARACTERS else [text]
        found = b"".join(b"".join(map(self.pieces.__getitem__, self.cut(part))) for part in parts)
        self.pieces.forget()
        return np.frombuffer(found, self.kind)

    def _parts(self, text: str) -> Iterable[str]:
        """Parts of about CHARACTERS, each of which begins with a blank before a letter, after what is not blank."""
        at = 0
        while at < len(text):
            found = self.part_end(text, at + CHARACTERS) if at + CHARACTERS < len(text) else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes of each id."""
        byte_of = {c: b for b, c in byte_characters().items()}
        out = [b""] * self.size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = token.content.encode()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)
