"""What an accepted suggestion or an edit does to the text around the caret, as column functions.

Offsets count characters from 0; a line holds no line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as X

#: fixed values: what one word, abbreviations included, looks like, and the characters that one may have
WORD = r"^[A-Za-z][A-Za-z'-]*(?:\.[A-Za-z'-]+)*\.?\z"
INSIDE = "[A-Za-z'.-]"
#: fixed values: openers that hug the word they wrap, and what marks a link
OPENERS = "([{\"'“‘"
LINK = r"\[\[|\]\]|\]\("


def _from(text: Column, at: Column | int) -> Column:
    """The text from an offset."""
    at = at if isinstance(at, Column) else F.lit(at)
    return text.substr(at + 1, F.length(text))


def _starts(text: Column, head: Column) -> Column:
    return F.lower(text).startswith(F.lower(head))


def completion_suffix(top: Column, query: Column) -> Column:
    """What of a completion is left to type; empty where it does not go on from the query."""
    goes_on = _starts(top, query) & (F.length(top) > F.length(query))
    return F.when(F.coalesce(query, F.lit("")) == "", F.coalesce(top, F.lit(""))).when(goes_on, _from(top, F.length(query))).otherwise("")


def ghost_after(ghost: Column, inserted: Column) -> Column:
    """A pending completion once `inserted` was typed at its anchor; null when that is another way on or its end."""
    follows = (F.length(inserted) > 0) & _starts(ghost, inserted) & (F.length(ghost) > F.length(inserted))
    return F.when(follows, _from(ghost, F.length(inserted)))


def phrase_left(phrase: Column, typed: Column, query: Column) -> Column:
    """What is left of a phrase after `typed`, while the word being typed still follows it; else null."""
    left = _from(phrase, F.length(typed))
    return F.when(_starts(phrase, typed) & (F.trim(left) != "") & _starts(left, query), left)


def raised_like(query: Column, text: Column) -> Column:
    """The text with a capital where the query begins with one, or with what has no case."""
    first = F.substring(query, 1, 1)
    raised = F.concat(F.upper(F.substring(text, 1, 1)), _from(text, 1))
    return F.when((first != "") & (first == F.upper(first)), raised).otherwise(text)


def spaced_before(line: Column, at: Column, insert: Column) -> Column:
    """The insert with the space that parts it from the word before the caret."""
    before = line.substr(at, F.lit(1))
    tight = (at == 0) | (insert == "") | X.starts_tight(insert) | (before == "") | before.rlike(r"\s") | F.lit(OPENERS).contains(before)
    return F.when(tight, insert).otherwise(F.concat(F.lit(" "), insert))


def spaced_after(line: Column, end: Column, insert: Column) -> Column:
    """An insert that ends in punctuation with a space, unless white space follows it."""
    return F.when((insert == "") | ~X.ends_tight(insert) | line.substr(end + 1, F.lit(1)).rlike(r"\s"), insert).otherwise(F.concat(insert, F.lit(" ")))


def start_over_space(line: Column, at: Column, insert: Column) -> Column:
    """Where the replaced range begins: punctuation takes the space before the caret along."""
    return F.when(X.starts_tight(insert) & (at > 0) & (line.substr(at, F.lit(1)) == " "), at - 1).otherwise(at)


def start_over_double(line: Column, at: Column, insert: Column) -> Column:
    """Where the replaced range begins: the second of two spaces goes, unless the insert brings its own."""
    return F.when(insert.startswith(" "), at).otherwise(X.double_space_start(line.substr(F.lit(1), at)))


def pinned_case(token: Column, pinned: Column, begins: Column) -> Column:
    """A dictionary's spelling in the case of its place: capitals if typed so, a capital where a sentence begins."""
    capitals = (F.length(token) > 1) & (token == F.upper(token)) & (token != F.lower(token))
    return F.when(capitals, F.upper(pinned)).when(begins, X.capitalize_first(pinned)).otherwise(pinned)


def line_at(text: Column, at: Column) -> tuple[Column, Column]:
    """The parts of an offset's line before and after it."""
    return F.regexp_extract(text.substr(F.lit(1), at), r"([^\n]*)\z", 1), F.regexp_extract(_from(text, at), r"^([^\n]*)", 1)


def word_at(before: Column, after: Column, selection: Column | None = None) -> Column:
    """The selection if it is one word, else the word around the caret in its line; null where there is none."""
    around = F.concat(F.regexp_extract(before, f"({INSIDE}*)\\z", 1), F.regexp_extract(after, f"^({INSIDE}*)", 1))
    word = F.regexp_replace(F.regexp_replace(around, r"^['.-]+", ""), r"^['-]+|['-]+\z", "")
    word = F.when(word.rlike(WORD), word)
    if selection is None:
        return word
    chosen = F.trim(F.coalesce(selection, F.lit("")))
    return F.when(chosen == "", word).when(chosen.rlike(WORD), chosen)


def paragraph_at(text: Column, at: Column) -> Column:
    """The lines around an offset up to blank ones, joined by spaces, without a link that was begun at the end."""
    lines = F.split(text, "\n", -1)
    no = F.size(F.split(text.substr(F.lit(1), at), "\n", -1)) - 1
    blank = lambda part: F.transform(part, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) == "")

    def run(part: Column) -> Column:
        first = F.array_position(blank(part), True)
        return F.when(first == 0, F.size(part)).otherwise(first - 1).cast("int")

    above, below = F.slice(lines, 1, no), F.slice(lines, no + 2, F.size(lines))
    up, down = run(F.reverse(above)), run(below)
    joined = F.array_join(F.slice(lines, no - up + 1, up + down + 1), " ")
    return F.regexp_replace(F.regexp_replace(joined, r"\[\[[^\]]*\z", ""), r"^\s+|\s+\z", "")


def is_indent_edit(line_to_end: Column, inserted: Column) -> Column:
    """Whether an edit inserts blanks, or nothing, into the blanks that a line begins with."""
    return inserted.rlike(r"^[ \t]*\z") & line_to_end.rlike(r"^[ \t]*\z")


def removes_link(removed: Column, inserted: Column) -> Column:
    """Whether an edit takes link markup out and puts none in."""
    return removed.rlike(LINK) & ~inserted.rlike(LINK)


def finished_tags(tags: Column, caret: Column) -> Column:
    """Of tags (tag, end), those that do not end at the caret, where one is still being typed."""
    return F.transform(F.filter(tags, lambda t: caret.isNull() | (t["end"] != caret)), lambda t: F.regexp_replace(t["tag"], "^#", ""))


def with_tag(tags: Column, tag: Column) -> Column:
    """A note's tags with one more, unless it is there in any case."""
    clean = F.trim(F.regexp_replace(tag, "^#", ""))
    own = F.transform(tags, lambda t: F.regexp_replace(t, "^#", ""))
    known = F.exists(own, lambda t: F.lower(t) == F.lower(clean))
    return F.when((clean == "") | known, own).otherwise(F.concat(own, F.array(clean)))


def saving(insert: Column, typed: Column) -> Column:
    """Keys that accepting saves: the characters left, and one more where a space follows of itself; 0 once typed out."""
    left = F.length(insert) - F.length(typed)
    return F.when(left <= 0, 0).otherwise(left + X.ends_tight(insert).cast("int"))
