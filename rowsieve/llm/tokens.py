"""Token ids of whole texts, with a bounded memory of chunks already encoded."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

#: White space other than space and line break: texts holding any of it are encoded whole.
_RARE_SPACE = re.compile(
    r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
#: A capital and a mark that only its small letter is composed with (as j and a caron): the
#: tokenizer composes before it lowers, so texts holding such pairs are encoded whole.
_CAPITAL_MARK = re.compile("[A-Z][\u0300-\u036f]")
#: What can close a word: a run of it is a piece of its own to the tokenizers. No apostrophe,
#: which a word can go on behind.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Chunks that an encoder remembers, about: some 250 MB of them.
REMEMBER = 1_200_000
#: Last letter of the scripts (Latin, Greek, Cyrillic) whose letters no Unicode version disputes.
_LETTERS = "\u052f"


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write a byte that shows as its Latin-1 letter, others from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 0x100 + hidden.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()
_BLANK = _BYTE_LETTERS[0x20]
_AS_LETTERS = dict(enumerate(_BYTE_LETTERS))


class _Known(dict):
    """Ids by chunk; a chunk met for the first time is learned on the spot, so that texts are gone
    through once."""

    def __init__(self, learn: Callable, items: Iterable = ()):
        super().__init__(items)
        self.learn = learn

    def __missing__(self, chunk) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


class ChunkEncoder:
    """Encodes texts with a tokenizers file; ids equal those of ``encode`` on the whole text.

    Both supported kinds of tokenizer cut a text before they look at letters, and never across
    the end of a word: byte-level ones keep a single space with the word behind it, word ones
    drop white space. So a text's ids are those of its chunks, and a chunk's ids are remembered
    (about ``remember`` chunks, then the older half goes). A chunk that is one run of common letters
    is one word to the tokenizer, so it goes straight to its model, which takes half the time. A text with unusual white space,
    two blanks in a row or a special token is encoded whole, and so is every text if the file
    is of another kind.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            parts = json.load(source)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.kind = _kind(parts)
        self.remember = remember
        self.known = _Known(self._learn)
        self.tails: dict = {}
        self.tail = _TAIL.encode() if self.kind == "word" else _TAIL
        self.tokenize = self.tokenizer.model.tokenize
        self.line = self._whole("\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        step, size = [], 0
        for text in texts:
            step.append(text)
            size += len(text)
            if size > 1_000_000:
                out += self._encode(step)
                step, size = [], 0
        return out + self._encode(step)

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids_of = self.known.__getitem__
        out = []
        for text in texts:
            chunks = self._chunks(text)
            if chunks is None:
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(ids_of, chunks)))
        if len(self.known) > self.remember:
            self.known = _Known(self._learn, islice(self.known.items(), len(self.known) // 2, None))
        return out

    def _chunks(self, text: str) -> list | None:
        if self.kind == "whole" or any(s in text for s in self.special):
            return None
        if self.kind == "word":
            if not text.isascii() and _CAPITAL_MARK.search(text):
                return None
            # Lower case of ASCII letters first: the tokenizer does the same.
            return text.encode("utf-8").lower().split()
        if not text:
            return []
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return None
        if _RARE_SPACE.search(text):
            return None
        # A chunk stands for itself behind a space; "\r" marks the first, which has none.
        return ("\r" + text).replace("\n", " \n").split(" ")

    def _learn(self, chunk) -> bytes:
        """Ids of a new chunk. A word's closing punctuation is looked up by itself, so a word is
        encoded once, with or without it."""
        word = chunk.rstrip(self.tail)
        letters = self._letters(word) if word else None
        if letters is None:
            return self._whole(self._text(chunk))
        if len(word) < len(chunk):
            tail = chunk[len(word) :]
            if tail not in self.tails:
                if len(self.tails) >= 10_000:
                    self.tails.clear()
                self.tails[tail] = self._whole(tail if isinstance(tail, str) else tail.decode())
            return self.known[word] + self.tails[tail]
        ids = _packed([t.id for t in self.tokenize(letters)])
        return self.line + ids if word[:1] == "\n" else ids

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word) -> str | None:
        """A chunk as the model gets it, its bytes written as the letters that stand for them, if
        it is one run of letters to the tokenizer; without the line break before it."""
        if self.kind == "word":
            if word.isascii():
                return word.decode() if word.isalpha() else None
            # Some capitals become a letter and a mark, which would join the punctuation. The
            # tokenizer lowers each letter by itself, so a sigma that ends a word is like any other.
            text = unicodedata.normalize("NFC", word.decode("utf-8"))
            text = text.replace("\u03a3", "\u03c3").lower()
            lead = ""
        else:
            lead = "" if word[0] in "\n\r" else _BLANK
            text = word if lead else word[1:]
        if not text.isalpha():
            return None
        if text.isascii():
            return lead + text
        if max(text) > _LETTERS:
            return None
        return lead + text.encode("utf-8").decode("latin-1").translate(_AS_LETTERS)

    def _text(self, chunk) -> str:
        if self.kind == "word":
            return chunk.decode("utf-8")
        if chunk[:1] == "\r":
            return chunk[1:]
        return chunk if chunk[:1] == "\n" else " " + chunk


def _kind(parts: dict) -> str:
    cut = parts.get("pre_tokenizer") or {}
    if parts.get("model", {}).get("type") != "BPE" or parts.get("post_processor"):
        return "whole"
    if cut.get("type") == "ByteLevel" and not parts.get("normalizer"):
        plain = cut.get("use_regex", True) and not cut.get("add_prefix_space")
        return "byte" if plain else "whole"
    steps = cut.get("pretokenizers") or []
    norm = [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])]
    if steps and steps[0].get("type") == "Split" and "Lowercase" in norm:
        drops = steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        inside = (steps[0].get("pattern") or {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        return "word" if drops and inside else "whole"
    return "whole"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, remember: int = REMEMBER) -> ChunkEncoder:
    """The encoder of a file; one for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].remember = remember
    return _ENCODERS[path]


def release() -> None:
    """Gives up this worker's encoders: Spark keeps workers for other work, which needs their memory."""
    while _ENCODERS:
        _ENCODERS.popitem()[1].known.clear()  # it and the encoder hold each other


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
