"""What a Python worker remembers of words from one task to the next."""

import sys

import pyarrow as pa
import tokenizers

from loomspan.llm import packing, word_tokens


def test_tasks_of_a_worker_share_what_it_learnt(monkeypatch):
    loads = []

    class Counted:
        @staticmethod
        def from_file(path):
            loads.append(path)
            return real.from_file(path)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    if hasattr(word_tokens, "word_bpe"):
        word_tokens.word_bpe.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "some more words"])], ["row", "text"])
    path = packing.default_tokenizer()
    tasks = [[b.to_pylist() for b in packing._pieces(path, 4096, False)(iter([batch]))] for _ in range(3)]
    assert tasks[0] == tasks[1] == tasks[2] and len(loads) == 1


def test_words_are_forgotten_by_generations(monkeypatch):
    bpe, once = (word_tokens.WordBpe(packing.default_tokenizer()) for _ in range(2))
    text = " ".join(f"word{i % 13}, Größe{i % 7}" for i in range(200)).encode()
    monkeypatch.setattr(word_tokens, "GENERATION", 5)
    few = bpe.ids([text])
    assert max(len(bpe.words), len(bpe.words.old), len(bpe.bodies), len(bpe.bodies.old)) <= 5
    monkeypatch.setattr(word_tokens, "GENERATION", 450_000)
    assert few == once.ids([text])


def test_what_a_worker_remembers_is_bounded_in_bytes():
    bpe = word_tokens.WordBpe(packing.default_tokenizer())
    for k in range(40):
        bpe.ids([" ".join(f"{chr(97 + i % 26)}{'abcdefghij'[k % 10]}{'klmn'[k // 10]}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}," for i in range(10_000)).encode()])
    long = ["ab" * 5000 + x for x in "cde"]
    assert bpe.ids([" ".join(long).encode()]) == [b"".join(bpe._encode(w) for w in long)]
    memos = {id(d): d for m in (bpe.words, bpe.bodies) for d in (m, m.old)}.values()
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in memos) < 64e6
    assert max(len(w) for d in memos for w in d) <= 64
