"""Token ids of words, remembered within a Python worker.

The tokenisers here never join text across white space, so that a text's ids are those of its words, one after the
other; words repeat, and one look-up is far cheaper than one encoding.
"""

from __future__ import annotations

import base64
import functools
import string

import numpy as np

#: Words in each of two generations that a WordBpe remembers (some 170 bytes each) from one task of a worker to the next:
#: when one is full, the one before it is forgotten, so that words which keep coming stay. An executor may have several
#: workers, which keep what they know while others run. Words of more bytes than LONG are not remembered.
GENERATION, LONG = 150_000, 64
#: The same for vocabularies that are there for one task alone (some 250 bytes each).
LEARNT = 450_000


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    out, more = [], 0x100
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out.append(chr(byte))
        else:
            out.append(chr(more))
            more += 1
    return out


class Remembered:
    """Values of words, in two generations."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def unknown(self, words: set) -> list:
        """Words of which neither generation has a value; those of the older one move to the newer."""
        if len(self.new) + len(words) > LEARNT:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for w in words:
            if w not in new:
                if (value := old.get(w)) is None:
                    out.append(w)
                else:
                    new[w] = value
        return out


class Memo(dict):
    """Values of words by a function, computed on the first look-up, in two generations."""

    def __init__(self, function):
        super().__init__()
        self.function, self.old = function, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.function(word)  # may look up, and so remember, another word
        if len(word) <= LONG:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """The tokenizer of a path, with the words that it remembers: one for all tasks of a Python worker."""
    return WordBpe(path)


class WordBpe:
    """Word ids (little-endian unsigned 32-bit, as bytes) of a byte-level BPE with word ends of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.words, self.tails = Memo(self._encode_word), {}
        self.bodies = self.words  # a plain word is its own body: one memory for both holds it once

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_body(self, body: str) -> bytes:
        """Of a lower-case run of plain letters, which is one pre-token: the model alone gives its ids."""
        letters = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _encode_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace").lower()
        body = text.rstrip(string.punctuation)
        # Letters below U+0250 are lower-cased and composed alike by every library; a run of marks after them
        # is one pre-token.
        if not (body.isalpha() and (body.isascii() or max(body) < "ɐ")):
            return self._encode(word.decode("utf-8", "replace"))
        if (plain := body.encode()) == word:
            return self._encode_body(body)
        tail = text[len(body) :]
        if not tail:
            return self.bodies[plain]
        if len(tail) > LONG:
            return self.bodies[plain] + self._encode(tail)
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._encode(tail)
        return self.bodies[plain] + self.tails[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]  # at ASCII white space


class Pieces:
    """Word ids of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(n)])
        self.words = Remembered()

    def learn(self, words: set[bytes]) -> None:
        new = self.words.unknown(words)
        for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)):
            self.words.new[w] = np.array(ids, dtype=np.int32).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of words that were learnt just before."""
        return np.frombuffer(b"".join(map(self.words.new.__getitem__, words)), dtype=np.int32)


class Ranks:
    """How many tokens words have under a byte-level vocabulary of ranks (of the tiktoken library), each after a space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = Remembered()

    def learn(self, words: set[bytes]) -> None:
        for w in self.words.unknown(words):
            self.words.new[w] = len(self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")))

    def count(self, words: list[bytes]) -> int:
        """Tokens of words that were learnt just before."""
        return sum(map(self.words.new.__getitem__, words))


def portions(texts: list, most: int = 2_000_000):
    """Runs of texts of that many bytes, or one text: what is split into words at once."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
