"""Token ids of public tokenizer files, with a bounded cache of chunks between white space."""

from __future__ import annotations

import os
import re
from array import array

# Letters whose lower case and normal form are single Latin-1 letters, then plain punctuation: such chunks need only the model.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)")
# Split characters of Python that the tokenizer's pattern does not take for white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Chunk to little-endian 32-bit ids, in two generations of `limit` bytes each.

    What was used since the last change of generation stays, however long ago it was made: a hit in the old generation moves
    to the young one, which becomes the old one when it is full. An entry counts with its key, its ids and its place in the table.
    Lower-case words, which need the model, have entries of their own; forms with capitals and signs are put together from them.
    Chunks above `longest` characters are not kept.
    """

    def __init__(self, path: str, limit: int = 52 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.longest, self.letters = Tokenizer.from_file(path), limit, longest, byte_letters()
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.model = self.tokenizer.model
        # The short way holds for word-end models over single letters and punctuation runs, which the file's settings show.
        self.short = self._agrees()

    def _agrees(self) -> bool:
        probe = ["Hello,", "STRASSE!!", "Élan.", "über", "ÑÑ;", "a", "zz-", "Word---"]
        return all(self._parts(*PLAIN.fullmatch(p).groups()) == self._whole(p) for p in probe)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _parts(self, word: str, tail: str) -> bytes:
        return self._model(word.lower()) + (self._model(tail) if tail else b"")

    def _made(self, chunk: str) -> tuple[bytes, bool]:
        """Ids of a chunk, and whether it is worth an entry: a form is if its word has been seen before."""
        plain = PLAIN.fullmatch(chunk) if self.short else None
        if plain is None:
            return self._whole(chunk), True
        word, tail = plain[1].lower(), plain[2]
        if word == chunk or tail == chunk:
            return self._model(chunk), True
        seen = word in self or word in self.old
        return self[word] + (self[tail] if tail else b""), seen

    def __missing__(self, chunk: str) -> bytes:
        ids, kept = self.old.pop(chunk, None), True
        if ids is None:
            ids, kept = self._made(chunk)
        if kept and len(chunk) <= self.longest:
            self.held += 190 + len(chunk) + len(ids)
            if self.held > self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 190 + len(chunk) + len(ids)
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a text, equal to those of one call of the tokenizer over it."""
        if ODD_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_OPEN: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One cache per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = ChunkIds(path)
    return _OPEN[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
