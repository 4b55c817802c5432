"""Text column expressions, all evaluated inside the JVM.

The character classes are spelled out instead of using ``\\w`` and ``\\s`` so that they keep
their Unicode meaning whatever flags the regex engine runs with.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from voxtable.functions import lexicons as lex

WORD_CHARS = r"\p{L}\p{N}_"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENTENCE_END = "\x1e"
KEPT_DOT = "\x1d"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    A lambda re-evaluates whatever it captures for every element, so a costly array must be
    bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# ---- whitespace -------------------------------------------------------------------------

def strip(text) -> Column:
    return F.btrim(_col(text), F.lit(SPACES))


def normalize_space(text) -> Column:
    """Strip, then turn every whitespace run into one space."""
    return F.trim(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def is_blank(text) -> Column:
    return F.length(strip(text)) == 0


def whitespace_words(text) -> Column:
    return F.filter(F.split(_col(text), f"{SPACE}+"), lambda w: w != "")


# ---- words ------------------------------------------------------------------------------

def word_runs(text, min_length: int = 1) -> Column:
    """Maximal runs of word characters, lowercased, at least ``min_length`` long."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(f"[{WORD_CHARS}]{{{min_length},}}"), F.lit(0))


def search_tokens(text) -> Column:
    return word_runs(text, 2)


def latin_words(text, min_length: int = 1) -> Column:
    """Words that consist of a-z only, lowercased."""
    pattern = f"(?<![{WORD_CHARS}])[a-z]{{{min_length},}}+(?![{WORD_CHARS}])"
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))


def without(tokens: Column, stop_words) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words))) if stop_words else tokens


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-word phrases of one token array."""
    if n == 1:
        return tokens

    def phrases(ts: Column) -> Column:
        return F.transform(F.slice(ts, 1, F.greatest(F.size(ts) - (n - 1), F.lit(0))),
                           lambda w, i: F.concat_ws(" ", w, *[F.get(ts, i + k) for k in range(1, n)]))

    return let(tokens, phrases)


def search_terms(text, stop_words=None) -> Column:
    """Unigrams and bigrams of the tokens left after stop-word removal."""
    kept = without(search_tokens(text), lex.SEARCH_STOP_WORDS if stop_words is None else stop_words)
    return let(kept, lambda ts: F.concat(ts, ngrams(ts, 2)))


def term_counts(terms: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of one document, counted inside the row.

    Sorting the array puts equal terms side by side; the run borders give the counts. No
    shuffle is needed to count terms per document.
    """
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")

    def runs(ts: Column) -> Column:
        n = F.size(ts)
        starts = F.filter(F.sequence(F.lit(1), n),
                          lambda i: (i == 1) | (F.get(ts, i - 1) != F.get(ts, i - 2)))
        return let(starts, lambda ss: F.transform(ss, lambda s, k: F.struct(
            F.get(ts, s - 1).alias("term"),
            (F.coalesce(F.get(ss, k + 1), n + 1) - s).cast("bigint").alias("tf"),
        )))

    return let(F.sort_array(terms), lambda ts: F.when(F.size(ts) > 0, runs(ts)).otherwise(empty))


def whole_word(term: str) -> str:
    """Regex for ``term`` bounded by non-word characters."""
    return f"(^|[^{WORD_CHARS}]){re.escape(term)}([^{WORD_CHARS}]|$)"


def has_word(text, term: str) -> Column:
    return F.coalesce(F.lower(_col(text)).rlike(whole_word(term.lower())), F.lit(False))


def matched_words(text, terms) -> Column:
    """The entries of ``terms`` that occur in the text as whole words, in list order.

    Plain words are looked up in the token set of the row, so the text is scanned once
    however long the list is; only entries with other characters get a regex each.
    """
    plain = [t for t in terms if re.fullmatch(r"\w+", t)]
    found = F.array_intersect(string_array(plain), word_runs(text))
    special = [F.when(has_word(text, t), F.lit(t)) for t in terms if t not in plain]
    if not special:
        return found
    found = F.concat(found, F.array_compact(F.array(*special)))
    return let(found, lambda fs: F.filter(string_array(terms), lambda t: F.array_contains(fs, t)))


def contained_keywords(text, keywords) -> Column:
    """Keywords that occur anywhere in the lowercased text, in list order."""
    return let(F.lower(_col(text)),
               lambda lowered: F.filter(string_array(keywords), lambda k: F.contains(lowered, k)))


# ---- sentences --------------------------------------------------------------------------

def sentences(text) -> Column:
    """Sentences with their punctuation; a full stop after an abbreviation does not split.

    Most texts hold no abbreviation; a plain search tells, and spares them the costly pattern.
    """
    t = _col(text)
    for mark in (SENTENCE_END, KEPT_DOT):
        t = F.replace(t, F.lit(mark), F.lit(" "))
    guard = f"(^|[^{WORD_CHARS}])({'|'.join(lex.ABBREVIATIONS)})\\."
    abbreviated = reduce(Column.__or__, [F.contains(_col(text), F.lit(f"{a}.")) for a in lex.ABBREVIATIONS])
    t = F.when(abbreviated, F.regexp_replace(t, guard, f"$1$2{KEPT_DOT}")).otherwise(t)
    t = F.regexp_replace(t, f"([.!?][\"')\\]]*){SPACE}+", f"$1{SENTENCE_END}")
    parts = F.transform(F.split(t, SENTENCE_END), lambda s: strip(F.replace(s, F.lit(KEPT_DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def review_sentences(text, stored=None) -> Column:
    """Stored sentences when there are any, else split ones, else the whole text."""
    whole = _col(text)
    split = let(sentences(text), lambda ss: F.when(F.size(ss) > 0, ss).otherwise(F.array(whole)))
    if stored is None:
        return split
    stored = _col(stored)
    return F.when(F.coalesce(F.size(stored), F.lit(0)) > 0, stored).otherwise(split)


# ---- excerpts ---------------------------------------------------------------------------

def cut(text, n: int, mark: str = "...") -> Column:
    c = _col(text)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def strip_tags(text) -> Column:
    return F.regexp_replace(_col(text), "<[^>]+>", "")


def _first_segment(text: Column, term) -> Column:
    needle = F.lower(term) if isinstance(term, Column) else F.lit(term.lower())
    return F.get(F.filter(F.split(text, "[.!?]+"), lambda s: F.contains(F.lower(s), needle)), 0)


def clean_excerpt(text, term, max_length: int = 150) -> Column:
    """First sentence-like segment with the term, tags removed, cut; else the head of the text."""
    c = _col(text)
    segment = _first_segment(c, term)
    head = strip_tags(F.concat(F.substring(c, 1, max_length), F.lit("...")))
    return F.when(segment.isNotNull(), cut(strip_tags(strip(segment)), max_length)).otherwise(head)


def snippet(text, term, max_length: int = 100) -> Column:
    return cut(strip(_first_segment(_col(text), term)), max_length)


def _windows(tokens: Column, term: str, window: int) -> Column:
    def all_windows(ts: Column) -> Column:
        hits = F.array_compact(F.transform(ts, lambda t, i: F.when(F.contains(t, F.lit(term)), i)))

        def around(i: Column) -> Column:
            first = F.greatest(i - window, F.lit(0))
            return F.slice(ts, first + 1, F.least(i + window + 1, F.size(ts)) - first)

        return F.transform(hits, around)

    return let(tokens, all_windows)


def context_windows(text, term: str, window: int = 5) -> Column:
    """One string per token that contains the term: the token with ``window`` words each side."""
    return F.transform(_windows(word_runs(text), term, window), lambda w: F.array_join(w, " "))


def context_words(text, term: str, window: int = 5) -> Column:
    """All words of all context windows; a word is repeated once per window it is in."""
    return F.flatten(_windows(word_runs(text), term, window))


# ---- display ----------------------------------------------------------------------------

def plain_stars(rating) -> Column:
    return F.expr(f"repeat('*', {rating})") if isinstance(rating, str) else F.repeat(F.lit("*"), rating)


def rating_stars(rating) -> Column:
    r = _col(rating).cast("int")
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), 5 - r))


def sentiment_symbol(state: Column) -> Column:
    return (F.when(state == "positive", "🟢").when(state == "negative", "🔴")
            .when(state == "neutral", "🟡").otherwise("⚪"))


def timeline(states) -> Column:
    return F.array_join(F.transform(_col(states), sentiment_symbol), "")


def transition_key(a: Column, b: Column) -> Column:
    return F.concat(F.substring(a, 1, 3), F.lit("_to_"), F.substring(b, 1, 3))


def beam_path_text(path, score) -> Column:
    return F.concat(F.array_join(_col(path), " → "), F.lit(" (score: "), fixed(score, 2), F.lit(")"))


def fixed(number, decimals: int) -> Column:
    """Fixed decimals, rounded from the exact binary value (half to even on true ties)."""
    return F.replace(F.format_number(_col(number), decimals), F.lit(","), F.lit(""))


def formatted_id(n, prefix: str = "R") -> Column:
    """``R000042``; grows past six digits instead of truncating."""
    return F.format_string(f"{prefix}%06d", _col(n))


def id_order(c="review_id") -> list[Column]:
    """Sort keys of formatted ids: a shorter number is a smaller one, also beyond six digits."""
    return [F.length(_col(c)), _col(c)]


def percent_text(share, decimals: int = 1) -> Column:
    return F.concat(fixed(_col(share) * 100, decimals), F.lit("%"))

