"""Quality rules from tokeniser fertility.

Two public vocabularies, not trained on this corpus, are cheap models of ordinary text: one of pieces with byte
fallback, and one of bytes for many languages. Each word is encoded by itself, and a text is measured by its characters
per token under both, its tokens per word, the share of its tokens that are byte fallbacks, and the entropy of its tokens. What is ordinary differs by language and script and (entropy) by length,
so that bands are set for each: the median over all distinct texts of the group (copies have one vote), and so many interquartile ranges to
either side. Markup, symbol runs, shouting and boilerplate lists fall outside. Groups with few documents take the
bands of their script, and at last those of all documents, however few these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import keep, passing
from loomspan.llm.textscan import prefix_sums, text_bytes, window_hashes, word_codes, word_spans
from loomspan.llm.word_tokens import Pieces, Ranks, portions

LEAST_WORDS = 50
MOST_REPEATED = 50
#: Interquartile ranges to either side of the median, and least widths of a band.
CHARS_SPREAD, WORD_SPREAD, ENTROPY_SPREAD, BYTE_SPREAD = 4.0, 5.0, 3.0, 5.0
CHARS_WIDTH, WORD_WIDTH, ENTROPY_WIDTH, BYTE_WIDTH = 0.1, 0.5, 0.4, 0.1
#: Distinct texts that a group must have for bands of its own.
LEAST_GROUP = 100

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First code points of blocks and the script they begin; coarse, as only groups are named by it.
_SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
            (0x0900, "indic"), (0x0E00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
            (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]
_STARTS, _NAMES = np.array([a for a, _ in _SCRIPTS]), [b for _, b in _SCRIPTS]


def default_vocabularies() -> tuple[str, str]:
    """Of pieces with byte fallback, and of bytes by ranks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    points = points[(points >= 0x41) & ~((points > 0x5A) & (points < 0x61))]
    if not len(points):
        return "other"
    return _NAMES[int(np.bincount(np.searchsorted(_STARTS, points, side="right") - 1).argmax())]


def repeated_words(codes: np.ndarray, size: int = 3) -> int:
    """Words in windows of that many that are found twice or more in the text."""
    if len(codes) < size:
        return 0
    _, which, counts = np.unique(window_hashes(prefix_sums(codes), size), return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    for i in range(size):
        covered[at + i] = True
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


_MEASURES = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
             "n_tokens": pa.int64(), "n_byte_tokens": pa.int64(), "byte_share": pa.float64(), "token_entropy": pa.float64(), "script": pa.string()}


def _measure(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ranks = Pieces(paths[0]), Ranks(paths[1])
        for batch in batches:
            out: dict[str, list] = {x: [] for x in _MEASURES}
            text_keys = []
            for part in portions(text_bytes(batch.column(0))):
                raws = [x.tobytes() for x in part]
                split = [x.split() for x in raws]
                distinct = set().union(*split)
                pieces.learn(distinct)
                ranks.learn(distinct)
                for data, raw, words in zip(part, raws, split):
                    starts, ends = word_spans(data)
                    ids = pieces.ids(words)
                    counts = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
                    chars = int(((data & 0xC0) != 0x80).sum()) - int(np.isin(data, (9, 10, 11, 12, 13, 32)).sum())
                    row = (
                        len(starts), chars, int(_SYMBOL[data].sum()), duplicate_lines(raw), repeated_words(word_codes(data, starts, ends)),
                        len(ids), ranks.count(words), float(pieces.is_byte[ids].mean()) if len(ids) else 0.0, float(-(counts * np.log2(counts)).sum()) + 0.0, script_of(raw.decode("utf-8", "replace")),
                    )
                    for name, x in zip(out, row):
                        out[name].append(x)
                    text_keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(out[x], k) for x, k in _MEASURES.items()), pa.array(text_keys, pa.binary())], ["row", *out, "text_key"])

    return run


def _bands(measured: DataFrame, of: list[str], name: str) -> DataFrame:
    quartiles = lambda c: F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias(f"q_{c}")
    q = measured.groupBy(*of).agg(F.count("*").alias("n"), *map(quartiles, ("chars_per_token", "chars_per_byte_token", "tokens_per_word", "byte_share", "token_entropy"))).where(F.col("n") >= (LEAST_GROUP if of else 1))

    def edge(c: str, spread: float, width: float, sign: int) -> F.Column:
        q1, q2, q3 = (F.col(f"q_{c}")[i] for i in range(3))
        return q2 + sign * F.greatest(F.lit(width), spread * (q3 - q1))

    return q.select(*of, F.struct(
        edge("chars_per_token", CHARS_SPREAD, CHARS_WIDTH, -1).alias("low_chars"), edge("chars_per_token", CHARS_SPREAD, CHARS_WIDTH, 1).alias("high_chars"),
        edge("chars_per_byte_token", CHARS_SPREAD, CHARS_WIDTH, -1).alias("low_byte_chars"), edge("chars_per_byte_token", CHARS_SPREAD, CHARS_WIDTH, 1).alias("high_byte_chars"),
        edge("tokens_per_word", WORD_SPREAD, WORD_WIDTH, 1).alias("high_words"), edge("byte_share", BYTE_SPREAD, BYTE_WIDTH, 1).alias("high_byte"), edge("token_entropy", ENTROPY_SPREAD, ENTROPY_WIDTH, -1).alias("low_entropy"),
    ).alias(name))


def quality_rules(docs: DataFrame, text_column: str = "text", lang_column: str | None = "lang", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Each row of docs, without its text, with its measures, base_failed, reasons (array) and kept.

    A null text has no words and fails the base rules. A null language goes by its script. Ties, repeated rows and
    other columns have no influence; columns of these names are replaced. An empty table gives an empty table."""
    new = [*_MEASURES, "chars_per_token", "chars_per_byte_token", "tokens_per_word", "base_failed", "reasons", "kept"]
    others = [c for c in docs.columns if c.lower() not in new and c != text_column]
    lang = F.col(f"`{lang_column}`") if lang_column and lang_column in docs.columns else F.lit(None).cast("string")
    row = F.struct(lang.alias("lang"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(F.coalesce(text_column, F.lit("")).alias("text"), row.alias("row"))
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {kinds[v]}" for k, v in _MEASURES.items()) + ", text_key binary"
    x = rows.mapInArrow(_measure(vocabularies or default_vocabularies()), schema).withColumns(
        {
            "chars_per_token": F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")),
            "chars_per_byte_token": F.when(F.col("n_byte_tokens") > 0, F.col("word_chars") / F.col("n_byte_tokens")),
            "tokens_per_word": F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "g": F.coalesce(F.col("row.lang"), F.concat(F.lit("script "), "script")),
            "octave": F.floor(F.log2(F.greatest(F.lit(1), "n_tokens"))).cast("int"),
        }
    )
    with passing() as stay:
        x = stay(keep(x))
        # All but the language follows from the text, so that distinct rows are distinct texts (of a language, of all).
        measures = ["text_key", "script", "octave", "chars_per_token", "chars_per_byte_token", "tokens_per_word", "byte_share", "token_entropy"]
        by_lang = keep(x.where("not base_failed").select("g", *measures).distinct())
        by_text = keep(by_lang.select(*measures).distinct())
        # Bands of the language and length, else of the language, the script, all: as many rows as there are such groups.
        tiers = [(["g", "octave"], "b0"), (["g"], "b1"), (["script", "octave"], "b2"), (["script"], "b3"), ([], "b4")]
        y = x
        for of, name in tiers:
            bands = stay(keep(_bands(by_lang if "g" in of else by_text, of, name)))
            y = y.join(bands, of, "left") if of else y.join(F.broadcast(bands), how="left")  # one row
    band = F.coalesce(*(name for _, name in tiers))
    length_band = F.coalesce("b0", "b2", "b1", "b3", "b4")
    reasons = F.array_compact(F.array(
        F.when(F.col("base_failed"), F.lit("base")),
        F.when(~F.col("chars_per_token").between(band["low_chars"], band["high_chars"]), F.lit("characters per token")),
        F.when(~F.col("chars_per_byte_token").between(band["low_byte_chars"], band["high_byte_chars"]), F.lit("characters per byte token")),
        F.when(F.col("tokens_per_word") > band["high_words"], F.lit("tokens per word")),
        F.when(F.col("byte_share") > band["high_byte"], F.lit("byte fallback")),
        F.when(F.col("token_entropy") < length_band["low_entropy"], F.lit("token entropy")),
    ))
    y = y.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)
    return y.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), *new)
