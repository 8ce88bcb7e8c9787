"""The zone that the end of a text lies in, for a batch of texts at a time.

Rules look at the last line, at its last run without white space and at marks
that are counted once, so a text costs what its length does, however long its
lines and words are.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what lists.SPACE names
SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
FENCES = ("```", "~~~")
SINGLE = re.compile(r"(?<!\$)\$(?!\$)")
TAG = re.compile(r"#[A-Za-z0-9_/-]*\Z")
HEADING = re.compile(f"#{{1,6}}[{SPACE}]")
ADDRESS = re.compile(r"https?://|www\.|.@", re.ASCII | re.IGNORECASE)
LETTERS = re.compile("[A-Za-z]+")


def _last_run(line: str) -> str:
    """What follows the last white space."""
    at = len(line)
    while at and line[at - 1] not in SPACE:
        at -= 1
    return line[at:]


def _open_fence(lines: list[str]) -> str:
    """The mark of the fence that is open after lines; it closes at the next marker of its own kind, others inside it count for nothing."""
    mark = ""
    for line in lines:
        if (bare := line.lstrip(SPACE)).startswith(FENCES):
            mark = bare[0] if not mark else "" if mark == bare[0] else mark
    return mark


def zone(text: str | None) -> str:
    """The first that fits of eleven."""
    if text is None:
        return "text"
    lines = text.split("\n")
    line = lines[-1]
    if lines[0].strip(SPACE) == "---" and not any(x.strip(SPACE) in ("---", "...") for x in lines[1:-1]):
        return "frontmatter"
    if _open_fence(lines[:-1]) or line.lstrip(SPACE).startswith(FENCES):
        return "codeBlock"
    if text.count("$$") % 2:
        return "mathBlock"
    if text.count("%%") % 2:
        return "comment"
    if line.count("`") % 2:
        return "inlineCode"
    if sum(1 for _ in SINGLE.finditer(line)) % 2:
        return "mathInline"
    if line.rfind("[[") > line.rfind("]]"):
        return "wikilink"
    token = _last_run(line)
    if line.rfind("](") > line.rfind(")") or token.startswith(("http://", "https://", "www.")):
        return "linkUrl"
    if TAG.match(token) and not HEADING.match(line):
        return "tag"
    return "bareUrl" if ADDRESS.search(token) else "text"


def shouts(text: str | None) -> bool:
    """Whether two capitals in the word being typed, or two all-capital words, stand before the cursor."""
    words = [m[0][::-1] for m in islice(LETTERS.finditer((text or "")[::-1]), 3)]
    first, second, third = ([w == w.upper() for w in words] + [False] * 3)[:3]
    if LETTERS.match((text or "")[-1:]):
        return first and (len(words[0]) >= 2 or (second and third))
    return first and second


def zone_of(text: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([zone(t) for t in x.to_pylist()], pa.string()), T.StringType())(text)


def shouts_at(text: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([shouts(t) for t in x.to_pylist()], pa.bool_()), T.BooleanType())(text)
