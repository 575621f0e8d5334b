"""Tokenising whole texts with a public tokenizer file, one word at a time from a bounded cache.

A byte-level BPE file cuts a text into words first and encodes each word alone. Where a text's white space is
single blanks and line feeds, the parts between these can therefore be encoded alone too and remembered; any other
text, or one that holds a special token's string, goes to the tokenizer whole. A part that begins with plain letters
and goes on with ASCII that is no letter (an apostrophe aside) is put together from these letters and its rest, which
recur more than the part; any other part is encoded as it is. All ways give the same ids.
"""

from __future__ import annotations

import re

import numpy as np

#: Entries kept by one Python worker in its caches of parts and of words; what comes later is encoded each time it is
#: met. They bound memory and change no result. Python doubles a dict's table at 699,051 entries.
CACHE_PARTS, CACHE_WORDS = 690_000, 600_000
#: Letters in every version of Unicode; a part's first run of these is one word to the tokenizer if the part ends there
#: or goes on with a character that is surely no letter or mark.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-&(-@\[-`{-~]|\Z)")
LINE = "\n"
#: Byte-level vocabularies write a byte as a printable character: itself, or one of those from 256 on in turn.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model if plain else None  # takes a word without the work of finding words
        self.parts: dict[str, bytes] = {}  # a part with a blank before it, or with a line feed as its first character
        self.words: dict[str, bytes] = {}  # the same for its first letters
        self.rests: dict[str, bytes] = {"": b""}  # what follows the letters

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (None counts as empty) as unsigned 32-bit integers."""
        return [np.frombuffer(self._ids(t), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]

    def _ids(self, text: str) -> bytes:
        spaced = text.replace(LINE, " " + LINE)  # a part after a line feed keeps it as its first character
        parts = spaced.split(" ")
        if " ".join(text.split()) != text.replace(LINE, " ") or any(s in text for s in self.special):
            return self._encode([text])[0]
        first, parts[0] = parts[0], ""
        found = [*map(self.parts.get, parts)]
        found[0] = self._encode([first])[0]
        if None in found:
            self._fill(parts, found)
        return b"".join(found)

    def _fill(self, parts: list[str], found: list[bytes | None]) -> None:
        words, rests, kept, match = self.words, self.rests, self.parts, LETTERS.match
        room, late, new_words, new_rests = len(kept) < CACHE_PARTS, [], {}, {}
        for i, x in enumerate(found):
            if x is None:
                part = parts[i]
                m = match(part, part[0] == LINE)
                word, rest = (part[: m.end()], part[m.end() :]) if m else (part, "")
                ids, more = words.get(word), rests.get(rest)
                if ids is None or more is None:
                    late.append((i, word, rest))
                    if ids is None:
                        new_words[word] = word if word[0] == LINE else " " + word
                    if more is None:
                        new_rests[rest] = rest
                    continue
                found[i] = ids = ids + more
                if room:
                    kept[part] = ids
        if not late:
            return
        new_words = dict(zip(new_words, map(self._word, new_words.values()), strict=True))
        new_rests = dict(zip(new_rests, self._encode(list(new_rests)), strict=True))
        for known, new in ((words, new_words), (rests, new_rests)):
            if len(known) < CACHE_WORDS:
                known.update(new)
        for i, word, rest in late:
            found[i] = ids = (new_words.get(word) or words[word]) + (new_rests[rest] if rest in new_rests else rests[rest])
            if room:
                kept[parts[i]] = ids

    def _word(self, word: str) -> bytes:
        """A blank or a line feed and letters, or any part that is kept as a word."""
        if self.model is None or not LETTERS.fullmatch(word, 1) or word[0] != " ":
            return self._encode([word])[0]
        return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTES))], np.uint32).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file; it lives as long as the worker."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def in_slices(texts: list[str], most_chars: int = 2_000_000) -> list[slice]:
    """Slices of about ``most_chars`` characters, so that a batch of very long texts stays small in memory."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            out.append(slice(begin, i + 1))
            begin, size = i + 1, 0
    return [*out, slice(begin, len(texts))] if begin < len(texts) else out
