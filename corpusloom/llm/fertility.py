r"""Quality rules over words and over what a public tokeniser makes of them.

Base rules count words, symbols, repeated lines and words in windows of WINDOW
words that occur twice or more in the same text. Fertility is measured with two
public vocabularies, word by word: characters per token of a SentencePiece
vocabulary with byte fallback, the share of its byte-fallback tokens and the
entropy of its tokens in bits; and characters per token of a byte-level BPE for
many languages, which noise costs more tokens than any language. Each distinct
word is encoded once and kept, WORDS of them at most per task. Words in capitals
alone are encoded in small letters, as vocabularies hold few in capitals.

Verdict: a text fails if any measure leaves its band. A language's own band,
where BANDS has one, goes before that of the text's script, and the script is
that of most of its letters (Latin, Latin of which a fifth or more has marks,
Greek, Cyrillic, Arabic, Hebrew, Devanagari, CJK, Hangul, other). Bands of scripts
lie below the values of running text in 23 languages (tests hold one paragraph of
each against them) and above those of random letters. Bands are fixed parameters: the least values of
a language were measured on texts labelled good and lie below the range of all
3,302 such texts at sf0.1, by half a standard deviation or more; the greatest
leave room for any language. A verdict depends on the text and its language
alone, whatever the size of the table. The entropy band holds from
ENTROPY_TOKENS tokens up, since short texts can't have much.

Null, empty and blank texts have zero in every count and fail the base rules.
A null or unknown language, or none at all, means the script's band; a null id is
an id like others. Repeated
rows are judged each. Texts of any length are measured whole. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import Words, blocks, mix64

WINDOW = 8
WORDS = 200_000
ENTROPY_TOKENS = 64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCRIPTS = ("none", "latin", "greek", "cyrillic", "arabic", "hebrew", "devanagari", "cjk", "hangul", "other", "marked")
MARKED = 5  # one in so many Latin letters
#: language or script: least characters per token of the pieces, least and most of the bytes, most byte-fallback share, least bits of entropy
BANDS = {
    "de": (1.85, 2.05, 7.00, 0.05, 4.4),
    "en": (1.70, 1.96, 7.00, 0.05, 4.4),
    "es": (1.65, 1.98, 7.00, 0.05, 4.4),
    "fr": (1.60, 1.75, 7.00, 0.05, 4.4),
    "latin": (1.50, 1.55, 7.00, 0.20, 4.0),
    "marked": (1.00, 1.20, 7.00, 0.20, 4.0),
    "greek": (0.70, 0.50, 7.00, 0.30, 3.0),
    "cyrillic": (1.00, 0.70, 7.00, 0.30, 3.0),
    "arabic": (0.70, 0.60, 7.00, 0.40, 3.0),
    "hebrew": (0.60, 0.50, 7.00, 0.40, 3.0),
    "devanagari": (0.45, 0.25, 7.00, 0.60, 3.0),
    "cjk": (0.35, 0.30, 7.00, 0.80, 3.0),
    "hangul": (0.35, 0.30, 7.00, 0.90, 3.0),
    "other": (0.25, 0.20, 7.00, 1.00, 2.0),
    "none": (0.80, 0.80, 7.00, 0.50, 2.0),
}
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, n_bpe_tokens long, entropy double, script string, lang string"


@cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def bpe(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def byte_pieces(path: str) -> np.ndarray:
    own = processor(path)
    return np.array([own.is_byte(k) for k in range(own.vocab_size())], bool)


def script_of(codes: np.ndarray) -> np.ndarray:
    """Each code point's script, as a number in SCRIPTS; 0 if it is no letter of note."""
    out = np.zeros(len(codes), np.int8)
    out[((codes | 32) >= 97) & ((codes | 32) <= 122) & (codes < 128)] = 1
    for number, low, high in ((1, 0xC0, 0x24F), (1, 0x1E00, 0x1EFF), (2, 0x370, 0x3FF), (3, 0x400, 0x52F), (5, 0x590, 0x5FF), (4, 0x600, 0x77F), (6, 0x900, 0x97F), (9, 0x980, 0x10FF), (8, 0x1100, 0x11FF), (9, 0x1200, 0x1DFF), (7, 0x3040, 0x30FF), (7, 0x3400, 0x9FFF), (8, 0xAC00, 0xD7AF), (7, 0x20000, 0x3FFFF)):
        out[(codes >= low) & (codes <= high)] = number
    return out


class Measure:
    """Measures blocks of texts; keeps the tokens of words it has met."""

    def __init__(self, path: str, bpe_path: str, pattern: str):
        self.path, self.bpe = path, (bpe_path, pattern)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.begin, self.ids, self.sizes = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def tokens(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, rows' bounds in self.ids)."""
        if len(self.rows) > WORDS:
            self.forget()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self.rows
        known = len(rows)
        places = np.array([rows.setdefault(h, len(rows)) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(places >= known)
        if len(new):
            texts = [words.raw[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())]
            texts = [t.lower() if t.isupper() and len(t) > 1 else t for t in texts]
            found = processor(self.path).encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((k for x in found for k in x), np.int32, int(sizes.sum()))])
            encode = bpe(*self.bpe).encode_ordinary
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(encode(t)) for t in texts), np.int64, len(texts))])
        return places[back], self.begin

    def block(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        words = Words(texts)
        hashes = words.hashes()
        docs = len(texts)

        def by_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
            return np.diff(total[words.offsets])

        buffer = words.buffer
        inside = (buffer != 0x20) & ((buffer < 0x09) | (buffer > 0x0D))
        repeats = np.zeros(docs, np.int64)
        starts, one, _ = words.windows(hashes, WINDOW)
        if len(starts):
            keys = mix64(one + words.doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.unique(np.concatenate([starts[order[1:][same]], starts[order[:-1][same]]]))
            change = np.zeros(len(hashes) + 1, np.int64)
            change[twice] += 1
            np.add.at(change, twice + WINDOW, -1)
            repeats = np.bincount(words.doc[np.cumsum(change[:-1]) > 0], minlength=docs)
        lines = np.zeros(docs, np.int64)
        for d, text in enumerate(texts):
            if text and "\n" in text:
                own = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
                lines[d] = len(own) - len(set(own))
        n_tokens, n_bytes, n_bpe, entropy = self.fertility(words, hashes, docs)
        codes = np.frombuffer(words.raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        heads = np.cumsum(by_text((buffer & 0xC0) != 0x80))
        scripts = script_of(codes)
        owner = np.repeat(np.arange(docs), np.diff(heads, prepend=0))
        letters = np.flatnonzero(scripts)
        counts = np.bincount(owner[letters] * len(SCRIPTS) + scripts[letters], minlength=docs * len(SCRIPTS)).reshape(docs, -1)
        script = counts.argmax(axis=1)
        marks = np.bincount(owner[(scripts == 1) & (codes > 127)], minlength=docs)
        script[(script == 1) & (marks * MARKED >= counts[:, 1])] = SCRIPTS.index("marked")
        return {
            "n_words": words.counts,
            "word_chars": by_text(inside & ((buffer & 0xC0) != 0x80)),
            "n_symbols": by_text(SYMBOLS[buffer]),
            "n_dup_lines": lines,
            "n_repeat_words": repeats,
            "n_tokens": n_tokens,
            "n_byte_tokens": n_bytes,
            "n_bpe_tokens": n_bpe,
            "entropy": entropy,
            "script": np.array(SCRIPTS)[script],
        }

    def fertility(self, words: Words, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, byte-fallback tokens, tokens of the byte-level BPE, entropy) of every text."""
        if not len(hashes):
            return *(np.zeros(docs, np.int64) for _ in range(3)), np.zeros(docs)
        rows, begin = self.tokens(words, hashes)
        sizes = begin[rows + 1] - begin[rows]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) - np.repeat(ends - sizes - begin[rows], sizes)]
        owner = np.repeat(words.doc, sizes)
        n_tokens = np.bincount(owner, minlength=docs)
        n_bytes = np.bincount(owner[byte_pieces(self.path)[ids]], minlength=docs)
        keys = np.sort(owner.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(at, len(keys))).astype(float)
        doc = (keys[at] >> np.uint64(32)).astype(np.int64)
        total = np.maximum(n_tokens, 1)
        entropy = np.log2(total) - np.bincount(doc, weights=counts * np.log2(counts), minlength=docs) / total
        n_bpe = np.bincount(words.doc, weights=self.sizes[rows], minlength=docs).astype(np.int64)
        return n_tokens, n_bytes, n_bpe, np.where(n_tokens > 0, np.maximum(entropy, 0), 0.0)


def measured(docs: DataFrame, path: str, bpe_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row of MEASURES per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(path, bpe_path, pattern)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for block in blocks(batches, most=2 << 20):
            found = measure.block(block["text"])
            columns = [pa.array(block["id"], pa.int64()), *(pa.array(found[n], pa.int64()) for n in names[1:9]), pa.array(found["entropy"], pa.float64()), pa.array(found["script"].tolist(), pa.string()), pa.array(block["lang"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, MEASURES)


def judged(found: DataFrame, bands: dict[str, tuple[float, float, float, float, float]] = BANDS) -> DataFrame:
    """Adds chars_per_token, chars_per_bpe_token, byte_share, base_failed and kept."""
    found = found.withColumn("chars_per_token", F.col("word_chars") / F.greatest("n_tokens", F.lit(1)))
    found = found.withColumn("chars_per_bpe_token", F.col("word_chars") / F.greatest("n_bpe_tokens", F.lit(1)))
    found = found.withColumn("byte_share", F.col("n_byte_tokens") / F.greatest("n_tokens", F.lit(1)))
    found = found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    band = F.when(F.col("lang").isin(*(b for b in bands if b not in SCRIPTS)), F.col("lang")).otherwise(F.col("script"))
    inside = F.lit(False)
    for name, (least, low, high, most, bits) in bands.items():
        good = (F.col("chars_per_token") >= least) & F.col("chars_per_bpe_token").between(low, high) & (F.col("byte_share") <= most) & ((F.col("entropy") >= bits) | (F.col("n_tokens") < ENTROPY_TOKENS))
        inside = F.when(band == name, good).otherwise(inside)
    return found.withColumn("kept", ~F.col("base_failed") & inside)
