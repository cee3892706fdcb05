"""Token ids of whole texts with a public tokenizer, remembered word by word.

Both vocabularies split a text at white space before they merge, so a text's ids
are its words' ids in order. A worker keeps the ids of the words it has met in a
bounded dictionary and asks the tokenizer only for new ones. Ids are those that
the library gives for the whole text without further settings: a special token's
string in a text (``<|endoftext|>``) is that token.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Words that a worker remembers; when full, those met again move to a new dictionary and the rest go.
MAX_REMEMBERED = 600_000
#: Longer words are encoded each time.
MAX_WORD = 48
#: Marks that may end a word.
TAIL = ".,;:!?%$#&*"
#: Letters below this code point and but for one have one lower-case letter each and no combining forms.
LATIN_END, DOTTED_I = "ɐ", "İ"


def plain_letters(word: str) -> bool:
    """True for Latin letters alone: either vocabulary takes such a run as one word, letter by letter."""
    return word.isascii() and word.isalpha() or word.isalpha() and max(word) < LATIN_END and DOTTED_I not in word


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for every byte: printable ones stand for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), as the whole text gives.

    ``spaced`` vocabularies take the space before a word into its first token and
    keep line feeds; there a text's first word has the key `` word`` and a line's
    first ``\\nword``. Others drop white space.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        self.before: dict[str, bytes | bool] = {}
        self.feed = self._whole("\n") if spaced else b""

    def clear(self) -> None:
        self.known: dict[str, bytes | bool] = {} if self.spaced else {"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _keys(self, text: str) -> list[str]:
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        lines = text.split("\n")
        keys = lines[0].split(" ")
        keys[0] = " " + keys[0]
        for line in lines[1:]:
            own = line.split(" ")
            own[0] = "\n" + own[0]
            keys += own
        return keys

    def _atom(self, key: str) -> bytes:
        """Ids of one word; a leading space in the key tells that none is before it."""
        word, open_ = (key[1:], "") if key[0] == " " else (key, " " if self.spaced else "")
        if plain_letters(word):
            if not self.spaced:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(("Ġ" if open_ else "") + word)]).tobytes()
        return self._whole(open_ + word)

    def _ids(self, key: str) -> bytes | bool:
        """Ids of a key; False if other white space is next to or in it, so that the whole text must be encoded."""
        known, body, feed = self.known, key, b""
        start = ""
        if self.spaced:
            if key[:1] in (" ", "\n"):
                start, body = " ", key[1:]
                feed = self.feed if key[0] == "\n" else b""
            if body.split() != [body]:
                return False
        word = body.rstrip(TAIL)
        if word and len(word) < len(body) and plain_letters(word[-1]):  # both vocabularies part letters from the marks after them
            parts = (start + word, " " + body[len(word) :])
        else:
            parts = (start + body,)
        out = feed
        for p in parts:
            if (ids := known.get(p)) is None:
                ids = self._atom(p)
                if len(p) <= MAX_WORD:
                    known[p] = ids
            out += ids
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        known, before = self.known, self.before
        for text in texts:
            if not text:
                yield b""
                continue
            if "<|" in text and any(s in text for s in self.specials):
                yield self._whole(text)
                continue
            if len(known) > MAX_REMEMBERED:
                self.before = before = known
                self.clear()
                known = self.known
            keys = self._keys(text)
            ids = list(map(known.get, keys))
            if None in ids:
                for k in [k for k, b in enumerate(ids) if b is None]:
                    key = keys[k]
                    if (b := known.get(key)) is None:
                        if (b := before.get(key)) is None:
                            b = self._ids(key)
                        if len(key) <= MAX_WORD:
                            known[key] = b
                    ids[k] = b
            try:
                yield b"".join(ids)
            except TypeError:  # a False
                yield self._whole(text)


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each vocabulary and worker."""
    return Encoder(path, spaced)
