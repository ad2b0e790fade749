"""Token ids of whole texts with public tokenizers, a word at a time.

Byte-pair tokenizers split a text before any merge, always between words. So
the ids of a text are those of its words in turn, and each worker keeps the ids
of words that it has met, in two generations of at most ``KEPT_BYTES`` each.
``space`` says what becomes of a space: ``"prefix"`` (it begins the next word)
or ``"drop"``. A text that holds an added token of the file, and every text of a
file whose pre-tokenizer or normalizer is not one known here, goes through the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of words and ids in a generation; what an entry takes besides them.
KEPT_BYTES, ENTRY_BYTES = 128 << 20, 200
#: Characters whose words are taken together.
TOGETHER = 1 << 23
#: Both ways must give its ids alike, or the file is not one that is known here.
PROBE = "It's A TEST of 12,345 words -- \u00e9\u00df, (x+y)=3.  Two  spaces\nand\ta line's end's 'll"
PATTERNS = {
    "prefix": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "drop": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_PLAIN = re.compile(r"[ -~\nÀ-ÿ]+")
_SPACED = re.compile(r" \s|\s ")
_INNER = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level models."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of words, and from them of texts."""

    def __init__(self, path: str, space: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.space = self.tokenizer.model, space
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        lead = os.path.commonprefix(added)  # such as "<|": seldom in a text, and quick to look for
        self._lead = lead[: next((k for k, c in enumerate(lead) if c.isalpha()), len(lead))]
        self._older: dict[str, bytes] = {}
        self._bytes, self.known = 0, True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self._split, self._letters = regex.compile(PATTERNS[space]), _byte_letters()
        self.known = self.encode(PROBE) == self.whole(PROBE)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _tokens(self, letters: str) -> bytes:
        return array(self.kind.char, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._of(word)
        self._bytes += ENTRY_BYTES + len(word) + len(ids)
        if self._bytes > KEPT_BYTES:
            self._older, self._bytes = dict(self), 0
            self.clear()
        self[word] = ids
        return ids

    def _of(self, word: str) -> bytes:
        led = word[:1] == " " and self.space == "prefix"
        body = word[1:] if led else word
        low = body if led or self.space == "prefix" else body.lower()
        if low != body and _PLAIN.fullmatch(word):
            ids = self[low]
        elif body.isascii() and body.isalpha():  # one word of letters that stand for themselves
            ids = self._tokens(self._letters[32] + body if led else body)
        elif not _PLAIN.fullmatch(word):
            ids = self.whole(word)
        else:
            parts = [word] if word.isalpha() else self._split.findall(word)
            if len(parts) == 1:
                ids = self._tokens(parts[0].encode().decode("latin-1").translate(self._letters))
            else:
                ids = b"".join(map(self.__getitem__, parts))
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes of ``kind``; null counts as empty."""
        if not text:
            return b""
        if not self.known or (self._added and self._lead in text and self._added.search(text)):
            return self.whole(text)
        if self.space == "drop":
            if _ODD.search(text):
                return self.whole(text)
            return b"".join(map(self.__getitem__, text.split()))
        if _SPACED.search(text):
            words = _INNER.split(text)
        else:
            words = text.split(" ")
        if len(words) == 1:
            return self[words[0]]
        # A space begins the word after it.
        return self[words[0]] + b"".join(map(self.__getitem__, map(" ".__add__, words[1:])))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text. Words after a space are numbered by Arrow, about
        ``TOGETHER`` characters of them at a time, so that each distinct one is looked
        up once; longer texts are cut at spaces. Texts that are not words between
        single spaces go through ``encode``."""
        out, apart, some, size = [[] for _ in texts], set(), [], 0
        for d, text in enumerate(texts):
            if not text or not self.known or self.space != "prefix" or (self._added and self._lead in text and self._added.search(text)):
                apart.add(d)
                continue
            at = text.find(" ")
            head = text if at < 0 else text[:at]
            if at >= 0 and (not head or head[-1].isspace()):
                apart.add(d)
                continue
            out[d].append(self[head])
            while at >= 0:
                end = text.find(" ", at + 1 + TOGETHER)
                some.append((d, text[at + 1 : end if end >= 0 else None]))
                size += len(some[-1][1])
                if size >= TOGETHER:
                    self._together(some, out, apart)
                    some, size = [], 0
                at = end
        if some:
            self._together(some, out, apart)
        return [self.encode(texts[d]) if d in apart else b"".join(x) for d, x in enumerate(out)]

    def _together(self, some: list[tuple[int, str]], out: list[list[bytes]], apart: set[int]) -> None:
        """Append the ids of pieces, all of whose words follow a space, to their texts'."""
        lists = pc.split_pattern(pa.array([x for _, x in some], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.array([not w or w != w.strip() for w in distinct])
        ids = [b"" if o else self[" " + w] for w, o in zip(distinct, odd, strict=True)]
        lengths = np.array([len(x) for x in ids]) // self.kind.itemsize
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), self.kind)
        n = lengths[codes]
        stops = np.concatenate([[0], np.cumsum(n)])
        all_ids = flat[np.repeat(starts[codes] - stops[:-1], n) + np.arange(stops[-1])]
        n_odd = np.concatenate([[0], np.cumsum(odd[codes])])[bounds]
        cuts = stops[bounds]
        for k, (d, _) in enumerate(some):
            if n_odd[k] < n_odd[k + 1]:
                apart.add(d)
            else:
                out[d].append(all_ids[cuts[k] : cuts[k + 1]].tobytes())


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, space: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if (path, space) not in _encoders:
        _encoders[path, space] = Encoder(path, space)
    return _encoders[path, space]
