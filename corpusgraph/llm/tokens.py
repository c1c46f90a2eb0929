"""Token ids of whole texts, encoded word by word with a bounded cache.

Both public vocabularies cut a text into words before they merge, and a single blank or line feed between two visible
characters always lies at such a cut. So the ids of a text are the joined ids of its words, and words repeat: most come
from a dictionary, the rest from the tokenizers library. Texts with any other white space are encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

END_ID = 1
CACHE_WORDS = 400_000

#: White space of either library besides blank and line feed, and pairs and ends that are not cuts.
_OTHER_SPACE = tuple("\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0     　") + tuple(map(chr, range(0x2000, 0x200B)))
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Letters, then signs: both libraries' patterns cut right between the two.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


_BYTES = str.maketrans(dict(enumerate(_byte_letters())))


def _regular(text: str) -> bool:
    """All white space is single blanks or line feeds between two visible characters."""
    return not (text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS) or any(c in text for c in _OTHER_SPACE))


def _latin(text: str) -> bool:
    """Lower-casing and composition are plain for these characters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, blanks: bool):
        """blanks: a word's ids depend on the blank before it (byte-level vocabularies), else white space is dropped and case folded."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.blanks = blanks
        self.feed = self._raw(["\n"])[0] if blanks else b""
        self.first: dict[str, bytes] = {}  # words at the start of a line
        self.rest: dict[str, bytes] = {}  # words after a blank

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, letters: str) -> bytes:
        """Ids of one word that the library's patterns don't cut."""
        as_bytes = letters.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def _learn(self, cache: dict[str, bytes], words: set[str], blank: str) -> dict[str, bytes]:
        """The cache with these words; one that is full first drops all others."""
        if len(cache) > CACHE_WORDS:
            cache = {w: cache[w] for w in words if w in cache}
        whole, signs_of = [], self.first
        for w in words.difference(cache):
            m = _PLAIN.fullmatch(w)
            if m and m[1].isalpha() and m[2].isascii() and (self.blanks or _latin(m[1])):
                letters, signs = m.groups()
                if not self.blanks:
                    letters = letters.lower()
                ids = cache.get(letters)
                if ids is None:
                    ids = cache[letters] = self._piece(blank + letters)
                if signs:
                    if signs not in signs_of:
                        signs_of[signs] = self._raw([signs])[0]
                    cache[w] = ids + signs_of[signs]
                else:
                    cache[w] = ids
            else:
                whole.append(w)
        cache.update(zip(whole, self._raw([blank + w for w in whole]), strict=True))
        return cache

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut = [i for i, text in enumerate(texts) if text and _regular(text)]
        odd = [i for i, text in enumerate(texts) if text and not _regular(text)]
        for i in odd:  # one at a time: a batch of long texts would hold the ids of all
            out[i] = self._raw([texts[i]])[0]
        for at in range(0, len(cut), 256):
            part = cut[at : at + 256]
            if self.blanks:
                lines = [[line.split(" ") for line in texts[i].split("\n")] for i in part]
                self.first = self._learn(self.first, {line[0] for doc in lines for line in doc}, "")
                self.rest = self._learn(self.rest, {w for doc in lines for line in doc for w in line[1:]}, " ")
                first, rest = self.first, self.rest.__getitem__
                for i, doc in zip(part, lines, strict=True):
                    out[i] = self.feed.join([b"".join([first[line[0]], *map(rest, line[1:])]) for line in doc])
            else:
                words = [(texts[i].lower() if _latin(texts[i]) else texts[i]).split() for i in part]
                self.rest = self._learn(self.rest, {w for doc in words for w in doc}, "")
                rest = self.rest.__getitem__
                for i, doc in zip(part, words, strict=True):
                    out[i] = b"".join(map(rest, doc))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """One encoder for each vocabulary and worker process; its cache lives as long as the worker."""
    if (path, blanks) not in _encoders:
        _encoders[path, blanks] = Encoder(path, blanks)
    return _encoders[path, blanks]
