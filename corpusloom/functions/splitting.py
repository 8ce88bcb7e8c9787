"""Sentences of a text as arrays of normalised words, for a batch of texts at a time.

The rules are those of text.normalize_word, is_sentence_terminator and
is_kernel_terminator, which work on a token at a time and which tests hold these
against. A token's word and whether it ends a sentence are worked out once for
each distinct token that a task has met lately.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import lists as L

KNOWN = 300_000  # tokens that a task remembers
NEVER, ALWAYS, BEFORE_CAPITAL = 0, 1, 2
CLOSED = re.compile(r"""["')\]]+\Z""")
END = re.compile(r"""[.!?…]["')\]]?\Z""")
SURE = re.compile(r"""[!?…]["')\]]?\Z""")
ACRONYM = re.compile(r"(?:[A-Za-z]\.)+[A-Za-z]?\Z")
BARE = re.compile(r"[a-z0-9](?:.*[a-z0-9])?", re.DOTALL)
TOKENS = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", L.NOT_SPACE) + "+")
# fixed values: small letters of capitals that Spark's Unicode has and Python 3.13's lacks; a sigma before one of them in a word may take its other form
LATE = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}}


def lowered(token: str) -> str:
    return (token if token.isascii() else token.translate(LATE)).lower()


def normalized(token: str) -> str:
    found = BARE.search(lowered(token))
    return found[0] if found else ""


def ending(token: str, abbreviations: Collection[str]) -> int:
    """Whether a token ends a sentence: NEVER, ALWAYS, or BEFORE_CAPITAL and at the end of the text."""
    if not END.search(token):
        return NEVER
    if SURE.search(token):
        return ALWAYS
    core = CLOSED.sub("", token)
    stem = core.removesuffix(".")
    if stem[-1:] in set("0123456789") or lowered(stem) in abbreviations:
        return NEVER
    return BEFORE_CAPITAL if ACRONYM.match(core) else ALWAYS


def kernel_ending(token: str, abbreviations: Collection[str]) -> int:
    if not END.search(token):
        return NEVER
    core = CLOSED.sub("", token)
    stem = lowered(core.removesuffix("."))
    plain = stem not in abbreviations and stem[-1:] not in set("0123456789") and not ACRONYM.match(core)
    return ALWAYS if plain or any(c in token for c in "!?…") else NEVER


def sentences_by(kernel: bool = False, abbreviations: Collection[str] = L.ABBREVIATIONS):
    """A UDF: the sentences of a text; none for null."""
    rule, short = (kernel_ending, frozenset(L.KERNEL_ABBREVIATIONS)) if kernel else (ending, frozenset(abbreviations))
    known: dict[str, tuple[str, int]] = {}

    def cut(texts: pa.Array) -> pa.Array:
        words, ends, rows = [], [0], [0]
        for text in texts.to_pylist():
            raw = TOKENS.findall(text or "")
            for i, token in enumerate(raw, 1):
                if (own := known.get(token)) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    own = known[token] = normalized(token), rule(token, short)
                word, end = own
                if word:
                    words.append(word)
                if end and (end == ALWAYS or i == len(raw) or "A" <= raw[i][0] <= "Z") and len(words) > ends[-1]:
                    ends.append(len(words))
            if len(words) > ends[-1]:
                ends.append(len(words))
            rows.append(len(ends) - 1)
        inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)

    # else the filters that Spark infers from explode() would run it a second time
    return F.arrow_udf(cut, T.ArrayType(T.ArrayType(T.StringType()))).asNondeterministic()
