"""Token ids of whole texts by a tokenizers file, with equal pieces of text encoded once per task."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# texts of these characters are cut by the files' own rule, written for this alphabet
_PLAIN = re.compile(f"[\n -~{_LETTERS}]*")
_PIECES = {
    True: re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"
    ),
    False: re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+"),
}
# other texts are cut at blanks, where pieces always end; the byte-level file takes one space
# into the next piece and keeps the last of several blanks apart
_UNITS = {True: re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]"), False: re.compile(r"[^ \n]+")}
# further white space joins the blanks around it: such texts go to the library whole
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MEMORY = 400_000
LONG = 100


def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes texts exactly as the library does on the whole text.

    The library cuts a text into pieces and encodes each piece by itself. Texts are cut here
    by the same rule, a new piece goes to the library's model, and its ids are remembered,
    which saves most of the work. Memory is bounded: long pieces are not kept, and a full
    memory starts anew. `spaced` says that a piece includes the space before it.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # bytes of an id, by the largest id of the file
        self.width = 2 if max(self._tokenizer.get_vocab(True).values(), default=0) < 1 << 16 else 4
        self._code = {2: "H", 4: "I"}[self.width]
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._spaced = spaced
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters))
        return array(self._code, [t.id for t in found]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _joined(self, pieces: list[str], encode: Callable[[str], bytes]) -> bytes:
        known = self._known
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) > MEMORY:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    found[i] = ids = known.get(piece) or encode(piece)
                    if len(piece) <= LONG:
                        known[piece] = ids
        return b"".join(found)

    def forget(self) -> None:
        """Drop the remembered pieces, at the end of a task."""
        self._known.clear()

    def ids(self, text: str) -> bytes:
        """The ids of a text as integers of `width` bytes, little-endian on the platforms Spark runs on."""
        if _PLAIN.fullmatch(text):
            pieces = _PIECES[self._spaced].findall(text if self._spaced else text.lower())
            return self._joined(pieces, self._piece)
        if _OTHER_SPACE.search(text):
            return self._whole(text)
        return self._joined(_UNITS[self._spaced].findall(text), self._whole)


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, spaced)
