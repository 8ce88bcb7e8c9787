r"""Text functions as Column expressions; each stays inside one row and one stage.

Java's \z stands where JavaScript has $ without the m flag, and white space is
spelled out, since Java's \s is ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.functions import zones

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _in(c: Column, words) -> Column:
    return c.isin(list(dict.fromkeys(words)))


def normalize_word(word: Column | str) -> Column:
    """Lower case without what is not a-z or 0-9 at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(word)), "^[^a-z0-9]+", ""), r"[^a-z0-9]+\z", "")


def tokenize_words(text: Column | str) -> Column:
    """Normalised words; null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(L.WORD), F.lit(0))
    return F.filter(F.transform(found, normalize_word), lambda x: x != "")


def tokenize_words_cased(text: Column | str) -> Column:
    """Words in their case and . , ! ? ; : as tokens."""
    plain = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[‘’]", "'")
    return F.regexp_extract_all(plain, F.lit(L.CASED), F.lit(0))


def raw_tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), f"{L.SPACE}+"), lambda x: x != "")


def is_sentence_terminator(token: Column | str, following: Column, abbreviations=L.ABBREVIATIONS) -> Column:
    """Whether a raw token ends a sentence, given the raw token that follows (null at the end)."""
    token = _col(token)
    core = F.regexp_replace(token, r"""["')\]]+\z""", "")
    stem = F.regexp_replace(core, r"\.\z", "")
    return (
        F.when(~token.rlike(r"""[.!?…]["')\]]?\z"""), False)
        .when(token.rlike(r"""[!?…]["')\]]?\z"""), True)
        .when(stem.rlike(r"\d\z"), False)
        .when(_in(F.lower(stem), abbreviations), False)
        .when(core.rlike(r"^([A-Za-z]\.)+[A-Za-z]?\z"), following.isNull() | following.rlike("^[A-Z]"))
        .otherwise(True)
    )


def is_kernel_terminator(token: Column | str) -> Column:
    """The kernel splitter's rule: a dotted acronym never ends a sentence."""
    token = _col(token)
    core = F.regexp_replace(token, r"""["')\]]+\z""", "")
    stem = F.lower(F.regexp_replace(core, r"\.\z", ""))
    plain = ~_in(stem, L.KERNEL_ABBREVIATIONS) & ~stem.rlike(r"\d\z") & ~core.rlike(r"(?i)^([a-z]\.)+[a-z]?\z")
    return token.rlike(r"""[.!?…]["')\]]?\z""") & (token.rlike("[!?…]") | plain)


def term_words(text: Column | str) -> Column:
    """Content words: three letters at least, no stop words."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(L.TERM), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"^['-]+|['-]+\z", ""))
    return F.filter(bare, lambda x: (F.length(x) >= 3) & ~_in(x, L.STOP_WORDS))


def sanitize_for_model(text: Column | str) -> Column:
    """Prose without code, math, markup and addresses; null gives the empty string."""
    steps = (
        (r"(?s)```.*?```", " "),
        (r"(?s)```.*\z", " "),
        (r"`[^`\n]*`", " "),
        (r"`[^`\n]*\z", " "),
        (r"(?s)\$\$.*?\$\$", " "),
        (r"\$[^$\n]*\$", " "),
        (r"\$[^$\n]*\z", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"</?[A-Za-z][^>\n]*>", " "),
        (r"!\[([^\]]*)\]\([^)\n]*\)", " "),
        (r"\[([^\]]*)\]\([^)\n]*\)", "$1"),
        (r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", "$1"),
        (rf"(?i)\b(?:https?://|www\.){L.NOT_SPACE}+", " "),
    )
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(_col(text), F.lit("")))


def context_words(preceding: Column | str) -> Column:
    return tokenize_words_cased(sanitize_for_model(preceding))


def strip_frontmatter(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?s)^\x{FEFF}?---\r?\n.*?\r?\n---[ \t]*\r?\n?", "")


def starts_tight(text: Column | str) -> Column:
    return _col(text).rlike("^[.,!?;:]")


def ends_tight(text: Column | str) -> Column:
    return _col(text).rlike(r"[.,!?;:]\z")


def join_phrase(words: Column | str) -> Column:
    """Words joined by spaces, clitics by an apostrophe."""
    joined = F.transform(_col(words), lambda w, i: F.when(i == 0, w).when(_in(F.lower(w), L.CLITICS), F.concat(F.lit("'"), w)).otherwise(F.concat(F.lit(" "), w)))
    return F.array_join(joined, "")


def harmonize_proper_case(surface: Column | str) -> Column:
    """Capitalises lower-case content words that stand before a capitalised word, from the right."""
    parts = F.reverse(F.split(_col(surface), " ", -1))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        after = F.try_element_at(done, F.lit(1))
        raised = F.concat(F.upper(F.substring(part, 1, 1)), part.substr(F.lit(2), F.length(part)))
        fits = F.coalesce(after.rlike("^[A-Z][a-z]"), F.lit(False)) & part.rlike(r"^[a-z]+\z") & ~_in(part, L.PHRASE_STOP_WORDS)
        return F.concat(F.array(F.when(fits, raised).otherwise(part)), done)

    return F.array_join(F.aggregate(parts, empty, step), " ")


def match_case(original: Column, replacement: Column) -> Column:
    first = F.substring(original, 1, 1)
    raised = F.concat(F.upper(F.substring(replacement, 1, 1)), replacement.substr(F.lit(2), F.length(replacement)))
    return (
        F.when(original == "", replacement)
        .when((original == F.upper(original)) & (F.length(original) > 1), F.upper(replacement))
        .when(first == F.upper(first), raised)
        .otherwise(replacement)
    )


def capitalize_first(word: Column | str) -> Column:
    """Upper case for the first letter A-Z, wherever it stands."""
    word = _col(word)
    lead = F.regexp_extract(word, r"(?s)^([^A-Za-z]*)", 1)
    at = F.length(lead) + 1
    return F.concat(lead, F.upper(word.substr(at, F.lit(1))), word.substr(at + 1, F.length(word)))


def fix_double_capital(word: Column | str) -> Column:
    word = _col(word)
    fixed = F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 1)), word.substr(F.lit(3), F.length(word)))
    return F.when(word.rlike(r"^[A-Z][A-Z][a-z]+\z"), fixed).otherwise(word)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def fix_contraction(word: Column | str) -> Column:
    """The word with its apostrophe, or null."""
    return _lookup(L.CONTRACTIONS, F.lower(_col(word)))


def should_capitalize_next(preceding: Column | str, abbreviations=L.ABBREVIATIONS) -> Column:
    preceding = _col(preceding)
    trimmed = F.regexp_replace(preceding, rf"{L.SPACE}+\z", "")
    last = F.regexp_extract(trimmed, rf"({L.NOT_SPACE}+)\z", 1)
    markers = rf"^{L.SPACE}*(?:(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|>[ \t]?)+\z"
    return (trimmed == "") | preceding.rlike(markers) | last.rlike(r"^[.!?…]+\z") | is_sentence_terminator(last, F.lit(None).cast("string"), abbreviations)


def auto_capitalized(word: Column, preceding: Column, canonical: Column, abbreviations=L.ABBREVIATIONS, begins: Column | None = None) -> Column:
    """Double capitals, the lone i, the canonical spelling and sentence starts, in this order; `begins`, where known, says if a sentence starts."""
    out = fix_double_capital(word)
    out = F.when(out == "i", F.lit("I")).otherwise(out)
    before = F.lower(F.regexp_extract(preceding, rf"(?:^|{L.SPACE})([A-Za-z][A-Za-z.]*)\.{L.SPACE}*\z", 1))
    after_abbreviation = _in(F.regexp_replace(before, r"\.\z", ""), abbreviations)
    first, lead = F.substring(out, 1, 1), F.substring(canonical, 1, 1)
    rest, other = out.substr(F.lit(2), F.length(out)), canonical.substr(F.lit(2), F.length(canonical))
    only_lead = (rest == other) & (first == F.lower(first)) & (lead == F.upper(lead)) & (F.length(out) == F.length(canonical))
    out = F.when(canonical.isNull() | (canonical == "") | (only_lead & after_abbreviation), out).otherwise(canonical)
    begins = should_capitalize_next(preceding, abbreviations) if begins is None else begins
    return F.when(begins, capitalize_first(out)).otherwise(out)


def upper_from_text(before: Column | str) -> Column:
    """Whether two capitals in the word being typed, or two all-capital words, stand before the cursor."""
    return zones.shouts_at(_col(before))


def suggestion_case(preceding: Column, upper: Column) -> Column:
    return F.when(upper, "upper").when(should_capitalize_next(preceding), "title").otherwise("none")


def apply_suggestion_case(text: Column, mode: Column) -> Column:
    return F.when(mode == "upper", F.upper(text)).when(mode == "title", capitalize_first(text)).otherwise(text)


def ordinal_suffix(digits: Column | str) -> Column:
    digits = _col(digits)
    two = F.right(digits, F.lit(2)).cast("int")
    one = F.right(digits, F.lit(1))
    return F.when(two.between(11, 13), "th").when(one == "1", "st").when(one == "2", "nd").when(one == "3", "rd").otherwise("th")


def fix_numeric_suffix(before: Column | str) -> Column:
    """struct(start, text) that puts a wrong ordinal or decade right, or null."""
    before = _col(before)
    # the longest run of digits before the suffix, as the first match from the left finds it
    lead, number, suffix = (F.regexp_extract(before, r"(?is)^(.*?)(\d+)(st|nd|rd|th)\z", k) for k in (1, 2, 3))
    right = ordinal_suffix(number)
    cased = F.when(suffix == F.upper(suffix), F.upper(right)).otherwise(right)
    fits = ~F.coalesce(lead.rlike(r"[A-Za-z0-9]\z"), F.lit(False))
    ordinal = F.when((F.lower(suffix) != right) & fits, F.struct(F.length(lead).alias("start"), F.concat(number, cased).alias("text")))
    era, years = (F.regexp_extract(before, r"(?s)^(.*?)(\d{2,4})'s\z", k) for k in (1, 2))
    decade = F.when((years != "") & ~era.rlike(r"[A-Za-z0-9]\z"), F.struct(F.length(era).alias("start"), F.concat(years, F.lit("s")).alias("text")))
    return F.when(suffix != "", ordinal).otherwise(decade)


def fraction_glyph(before: Column | str) -> Column:
    """struct(start, text) of the glyph for a fraction at the end, or null."""
    before = _col(before)
    found = F.regexp_extract(before, r"(?:^|[^\w/])(\d{1,2}/\d{1,2})\z", 1)
    glyph = _lookup(L.FRACTIONS, found)
    return F.when(glyph.isNotNull(), F.struct((F.length(before) - F.length(found)).alias("start"), glyph.alias("text")))


def double_space_start(line: Column | str) -> Column:
    """Where text goes on after a double space at the end of the line; its length otherwise."""
    line = _col(line)
    n = F.length(line)
    blank = F.regexp_replace(line, f"{L.SPACE}+", "") == ""
    return F.when(line.rlike(r"(^|[^ ])  \z") & ~blank, n - 1).otherwise(n)


def is_doubled_word(previous: Column, token: Column) -> Column:
    return F.coalesce((F.lower(previous) == F.lower(token)) & _in(F.lower(token), L.NEVER_DOUBLED), F.lit(False))


def is_profane(word: Column | str, allow: tuple[str, ...] = ()) -> Column:
    return _in(F.lower(_col(word)), [w for w in L.PROFANITY if w not in allow])


def blocked_surface(tokens: Column, allow: tuple[str, ...] = ()) -> Column:
    return F.exists(tokens, lambda w: is_profane(w, allow))


def _undouble(w: Column) -> Column:
    return F.when(w.rlike(r"(?:^|.)([^aeiou])\1\z") & (F.length(w) >= 3), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)


def stem(word: Column | str) -> Column:
    """Light stemming of a folded word, by the first suffix rule that fits."""
    w = _col(word)
    n = F.length(w)

    def cut(k: int) -> Column:
        return w.substr(F.lit(1), n - k)

    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("sses"), cut(2))
        .when(w.endswith("ing") & (n > 5), _undouble(cut(3)))
        .when(w.endswith("edly"), _undouble(cut(4)))
        .when(w.endswith("ed") & (n > 4), _undouble(cut(2)))
        .when(w.endswith("ly") & (n > 4), cut(2))
        .when(w.endswith("es") & (n > 4), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


def stem_candidates(word: Column | str) -> Column:
    """Bases of which any known one makes an inflected word known."""
    w = F.lower(_col(word))
    found = []
    for suffix in L.SUFFIXES:
        base = w.substr(F.lit(1), F.length(w) - len(suffix))
        fits = (F.length(w) >= 4) & w.endswith(suffix) & (F.length(w) - len(suffix) >= 3)
        found.append(F.when(fits, base))
        if suffix in ("ing", "ed"):
            found.append(F.when(fits, F.concat(base, F.lit("e"))))
            found.append(F.when(fits & base.rlike(r"(.)\1\z"), base.substr(F.lit(1), F.length(base) - 1)))
        if suffix in ("ies", "ied", "ier", "iest"):
            found.append(F.when(fits, F.concat(base, F.lit("y"))))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def is_acronym(word: Column | str) -> Column:
    core = F.regexp_replace(_col(word), r"s\z", "")
    return (F.length(core) >= 2) & (core == F.upper(core)) & core.rlike("[A-Z]")


def is_fragment(piece: Column | str) -> Column:
    return (F.length(_col(piece)) == 1) & ~_in(_col(piece), ["a", "i"])


def digit_glued(before: Column | str) -> Column:
    return _col(before).rlike(r"\d[A-Za-z]+\z")


def is_valid_tag(tag: Column | str) -> Column:
    return _col(tag).rlike(r"^[\p{L}\p{N}_/-]+\z") & _col(tag).rlike(r"[^\p{N}/_-]")


def has_link(text: Column | str) -> Column:
    return _col(text).rlike(r"\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)")


def block_words(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(L.BLOCK_WORD))


def inflection_class(word: Column | str) -> Column:
    w = _col(word)
    n = F.length(w)
    return F.when((n >= 5) & w.endswith("ing"), "ing").when((n >= 4) & w.endswith("ed"), "ed").when((n >= 4) & w.endswith("s") & ~w.endswith("ss"), "s").otherwise("")


def same_lemma(a: Column, b: Column) -> Column:
    """Whether one word begins with the other and is four letters longer at most, or both share four letters."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    root = (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & (F.length(short) >= 4)
    return (long.startswith(short) & (F.length(long) - F.length(short) <= 4)) | root


def is_negation_of(a: Column, b: Column) -> Column:
    prefixes = ("un", "in", "im", "dis", "non", "ir", "il")
    return reduce(lambda x, y: x | y, [(a == F.concat(F.lit(p), b)) | (b == F.concat(F.lit(p), a)) for p in prefixes])


def parse_exclude_list(text: Column | str) -> Column:
    trim = rf"^{L.SPACE}+|{L.SPACE}+\z"
    return F.filter(F.transform(F.split(_col(text), r"[\n,]"), lambda x: F.regexp_replace(x, trim, "")), lambda x: x != "")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored, case-insensitive Java pattern; ** crosses slashes and takes the one after it."""
    import re

    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    shown = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?i)^" + "".join(shown.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts if p) + r"\z"


def path_excluded(path: Column | str, patterns: list[str]) -> Column:
    """Exact path, folder prefix or glob, whatever the case."""
    p = F.regexp_replace(_col(path), "^/+", "")
    tests = [F.lit(False)]
    for raw in patterns:
        own = raw.strip().strip("/")
        if not own:
            continue
        if "*" in own or "?" in own:
            tests.append(p.rlike(glob_regex(own)))
        else:
            tests.append((F.lower(p) == own.lower()) | F.lower(p).startswith(own.lower() + "/"))
    return reduce(lambda a, b: a | b, tests)


def markdown_zone(before: Column | str) -> Column:
    """The zone that the end of a text lies in; the first that fits of eleven."""
    return zones.zone_of(_col(before))


def snippet_of(text: Column, heading: Column) -> Column:
    """The first line without marks, 100 characters at most, and an ellipsis if there is more."""
    marks = rf"^{L.SPACE}*(?:[-*+]|\d+[.)]){L.SPACE}+"
    trim = rf"^{L.SPACE}+|{L.SPACE}+\z"
    lines = F.filter(F.transform(F.split(text, r"\r?\n", -1), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, marks, ""), "[#>*_`]", ""), trim, "")), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), heading, F.lit(""))
    head = F.when(F.length(first) > 100, F.regexp_replace(F.substring(first, 1, 100), rf"{L.SPACE}+\z", "")).otherwise(first)
    return F.when((F.size(lines) > 1) | (F.length(first) > 100), F.concat(head, F.lit(" …"))).otherwise(head)


def link_text(target: Column, heading: Column, alias: Column) -> Column:
    return F.concat(F.lit("[["), target, F.coalesce(F.concat(F.lit("#"), heading), F.lit("")), F.coalesce(F.concat(F.lit("|"), alias), F.lit("")), F.lit("]]"))


def segment_key(text: Column | str) -> Column:
    return F.substring(F.lower(F.regexp_replace(_col(text), rf"^{L.SPACE}+|{L.SPACE}+\z", "")), 1, 80)


def group_thousands(digits: Column, separator: str) -> Column:
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+\z)", separator.replace("$", r"\$"))


def edit_budget(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 4 + 0.5).cast("int"))
