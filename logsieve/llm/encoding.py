"""Token ids of texts by a tokenizer file, with the ids of repeated pieces kept in a bounded memory."""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: The characters for which the class of a character is certain: Latin letters, digits, common white space and punctuation.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\r "
_PLAIN = re.compile(f"[\t\n\r -~¡-ɏ‐-‧‰-⁞]*+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]++| ?[{_NUMBER}]++| ?[^{_SPACE}{_LETTER}{_NUMBER}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

MEMORY_PIECES = 1_000_000  # a worker forgets its pieces when it holds so many


def _byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit numbers; an unknown piece is encoded by the library's merges."""

    def __init__(self, library: Tokenizer):
        self.merges = library.model

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        found = self[piece] = packed([t.id for t in self.merges.tokenize(written)])
        return found


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Ids as the tokenizers library gives them: no added special tokens, special strings in texts by its default.

    A byte-level file without normalizer cuts a text into pieces (a word with its blank, a number, ...) that are
    encoded on their own. For texts of common characters the cut is done here and the library's merges run once for
    each distinct piece; any other text, any text that holds a special string, and any other kind of file goes to the
    library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        cutter = spec.get("pre_tokenizer") or {}
        self.by_pieces = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
            and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        )
        self.special = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        self.known = _Pieces(self.library)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_pieces or any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        if len(self.known) > MEMORY_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)
