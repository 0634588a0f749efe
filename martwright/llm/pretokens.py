"""Exact pre-tokens and merges of a word-level BPE vocabulary file, quick for plain text."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Regex, Tokenizer, pre_tokenizers

# Texts made of these characters only need no normaliser but lower(): none of them composes
# with another, and each is lower-cased on its own.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿŒœ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-z0-9ß-öø-ÿœ]+")
# The split pattern that _PLAIN stands for; another vocabulary file always takes the library's path.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLOCK = 1 << 20
_LONG = 64


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """Cut a long text at spaces; pre-tokens never reach across one."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


class Vocabulary:
    """A ``tokenizers`` file with word pre-tokens, byte-level letters and BPE merges."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self._plain = steps[0]["pattern"] == {"Regex": _PATTERN}
        self._split = pre_tokenizers.Split(
            Regex(steps[0]["pattern"]["Regex"]), steps[0]["behavior"].lower(), invert=steps[0]["invert"]
        )
        self._bytes = {chr(b): c for b, c in enumerate(_byte_characters())}

    def pretokens(self, text: str) -> list[str]:
        """Normalised pre-tokens in order; special tokens of the text stand for themselves."""
        if self._cut and any(s in text for s in self.specials):
            found: list[str] = []
            for part in self._cut.split(text):
                if part in self.specials:
                    found.append(part)
                elif part:
                    found.extend(self._ordinary(part))
            return found
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[str]:
        if self._plain and not _OTHER.search(text):
            return _PLAIN.findall(text.lower())
        clean = self.tokenizer.normalizer.normalize_str(text)
        return [word for word, _ in self._split.pre_tokenize_str(clean)]

    def ids(self, pretoken: str) -> list[int]:
        """Ids of one pre-token by the exact merges of the file."""
        if pretoken in self.specials:
            return [self.specials[pretoken]]
        letters = "".join(map(self._bytes.__getitem__, pretoken.encode().decode("latin-1")))
        return [token.id for token in self.model.tokenize(letters)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


class PackedIds(dict):
    """Pre-token → its ids as little-endian unsigned 32-bit integers, merged on first use.

    Holds at most ``limit`` pre-tokens and starts afresh when full; very long ones are
    never held.
    """

    def __init__(self, words: Vocabulary, limit: int = 200_000):
        super().__init__()
        self.words, self.limit = words, limit

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.words.ids(pretoken)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(pretoken) <= _LONG:
            if len(self) >= self.limit:
                self.clear()
            self[pretoken] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if len(text) <= _BLOCK:
            return b"".join(map(self.__getitem__, self.words.pretokens(text)))
        return b"".join(
            b"".join(map(self.__getitem__, self.words.pretokens(part))) for part in blocks(text)
        )


@lru_cache(maxsize=4)
def packed_ids(path: str) -> PackedIds:
    """One cache per worker process, used by all its tasks."""
    return PackedIds(vocabulary(path))
