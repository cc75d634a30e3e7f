"""Token ids of whole texts by the tokenizers library, with what repeats encoded once.

A text is cut where other text turns into white space, and a word from the marks that end it. No
token of the two vocabulary kinds crosses such a cut, so the parts give the ids of the whole. Parts
repeat; the library sees each once per worker and bounded table. A word of Latin letters is one piece of
these vocabularies, so it goes to the library's BPE model at once, without its normalising and cutting. The
table has two ages: when the younger half is full it takes the place of the older one, from which parts come
back as they are met again.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

from memgov.llm.bpe import CHUNKS, WHITE, byte_symbols

KEPT_PARTS = 3 << 19
# Texts of other characters, or with the start of a special token, are not folded beforehand, nor are those with
# marks that str.split takes for white space.
_UNFOLDED = re.compile("[\x1c-\x1fİɐ-\U0010ffff]|<\\|")
# Latin letters, then ASCII marks without the apostrophe, which may begin a piece of its own.
_WORD_THEN_MARKS = re.compile(r"([\t\n\r ]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_SOME_OF_IT = re.compile(r"[\t\n\r ]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]*[!-&(-/:-@\[-`{-~]*")
_PROBES = (" Ab", "Zürich", " the", "déjà", " ǆungla", "x" * 40)


class _Parts(dict):
    """Part to its ids in bytes. A part that is not there is taken from the older half or encoded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.encode(part)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = found
        return found


class PartEncoder:
    def __init__(self, path: str, keep: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = {byte: ord(sign) for byte, sign in byte_symbols().items()}
        # A vocabulary that drops white space and case gives the same ids for parts without them.
        self.folds = self._ids(" \nÀb Cd") == self._ids("àb cd")
        self.chunks = re.compile(rf"[^{WHITE}]+" if self.folds else CHUNKS)
        # Special tokens that could be part of a word and its marks leave such parts whole.
        self.cuts = not any(_SOME_OF_IT.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        probes = [p.strip().lower() for p in _PROBES] if self.folds else _PROBES
        self.words = self.cuts and all(self._word(p) == self._whole(p) for p in probes)
        self.lines = self._whole("\nAb") == self._whole("\n") + self._whole("Ab")
        self.kept = _Parts(self._part, max(1, (keep or KEPT_PARTS) // 2))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, part: str) -> bytes:
        return array("I", self._ids(part)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters, with one blank ahead where blanks count: one piece for the model."""
        signs = word.encode().decode("latin-1").translate(self.symbols)
        return array("I", [token.id for token in self.model.tokenize(signs)]).tobytes()

    def _part(self, part: str) -> bytes:
        found = _WORD_THEN_MARKS.fullmatch(part) if self.cuts else None
        if not found:
            return self._whole(part)
        word, marks = found.groups()
        if marks:
            return self.kept[word] + self.kept[marks]
        if self.lines and word[0] == "\n" and word[1:2].strip():
            return self.kept["\n"] + self.kept[word[1:]]
        plain = word.islower() if self.folds else word[0] not in "\t\n\r" and word[:2].strip()
        return self._word(word) if self.words and plain else self._whole(word)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        of, out = self.kept.__getitem__, []
        for text in texts:
            parts = text.lower().split() if self.folds and not _UNFOLDED.search(text) else self.chunks.findall(text)
            out.append(b"".join(map(of, parts)))
        return out


@functools.lru_cache(1)
def encoder(path: str, keep: int | None = None) -> PartEncoder:
    """One encoder per worker process."""
    return PartEncoder(path, keep)
