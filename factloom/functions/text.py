"""Scalars over running text: contexts of a wording, sentences, names and addresses."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import CONTEXT_GAP, CONTEXT_STOP, CONTEXT_WORD, NAMESPACES


def run_of_words(most: int) -> str:
    """Regular expression of up to ``most`` words, each after a space or an apostrophe. Nothing that follows a run can match
    inside a word, so words are not given back (possessive), and a text costs a fixed number of steps for each of its words."""
    return rf"(?:{CONTEXT_GAP}{CONTEXT_WORD}++{CONTEXT_STOP}?+){{0,{most}}}"


def around(wording: Column, before: str, after: str) -> Column:
    """Regular expression of a sentence that holds the wording between the two expressions; sentences end before a character that is no digit."""
    literal = F.concat(F.lit(r"\s\Q"), F.replace(wording, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E{CONTEXT_STOP}?"))
    return F.concat(F.lit(rf"(?i)(?:^|\.)[^.]*?{before}"), literal, F.lit(rf"{after}(?:\s[^.]*)?\.(?:\D|$)"))


def wording_in_text(text: Column, wording: Column) -> Column:
    """Whether a wording stands in a sentence of the text. The plain search first spares the regular expression."""
    return F.contains(F.lower(text), F.lower(wording)) & F.regexp_like(text, around(wording, "", run_of_words(1)))


def contexts(text: Column, wording: Column, words: int = 3) -> Column:
    """Array of (preceding, following): the trimmed words around a wording in each sentence that holds it.

    One pass over the text finds the sentences, which end before the next one may start; the words are then taken out of each sentence alone."""
    run = run_of_words(words)
    sentences = F.regexp_extract_all(text, around(wording, "", run), F.lit(0))
    parted = around(wording, f"({run})", f"({run})")
    side = lambda s, k: F.regexp_replace(F.call_function("regexp_extract", s, parted, F.lit(k)), r"^\s+|\s+$", "")
    return F.transform(sentences, lambda s: F.struct(side(s, 1).alias("preceding"), side(s, 2).alias("following")))


def split_sentences(text: Column) -> Column:
    """Sentences of a paragraph: a break after ``.``, ``!`` or ``?`` (and a closing quote) before white space. Common
    abbreviations and initials do not end a sentence."""
    spaced = F.regexp_replace(text, r'([.!?])"(?=\S)', '$1" ')
    held = F.regexp_replace(spaced, r"\b(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|e\.g|i\.e|[A-Z])\.(?=\s)", "$1\u0001")
    parts = F.split(held, r'(?<=[.!?]|[.!?]")\s+')
    return F.filter(F.transform(parts, lambda s: F.translate(F.trim(s), "\u0001", ".")), lambda s: s != "")


def reject_reason(sentence: Column, longest: int = 1000, commas: int = 30) -> Column:
    """Why a parser does not take the sentence: it is a command of its shell, too long, or has too many commas; null if it does."""
    many = F.length(F.regexp_replace(sentence, "[^,]", "")) > commas
    return F.when(F.lower(sentence).isin("q", "eof"), "command").when(F.length(sentence) >= longest, "too long").when(many, "too many commas")


def admissible(sentence: Column, longest: int = 1000, commas: int = 30, decompose: bool = False) -> Column:
    """Whether a parser takes the sentence, after compatibility decomposition if ``decompose``; null for a null sentence."""
    return F.when(sentence.isNotNull(), reject_reason(nfkd(sentence) if decompose else sentence, longest, commas).isNull())


def escape_quotes(text: Column) -> Column:
    """Quotation marks as they stand inside a quoted string of a query."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def expand_iri(iri: Column) -> Column:
    """``prefix:name`` to the full IRI; what contains ``http`` stays; null for an unknown prefix."""
    known = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    return F.when(F.contains(iri, F.lit("http")), iri).otherwise(F.concat(F.element_at(known, F.split_part(iri, F.lit(":"), F.lit(1))), F.regexp_replace(iri, "^[^:]*:", "")))


def article_url(language: Column, title: Column) -> Column:
    return F.concat(F.lit("http://"), language, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def curid_url(prefix: Column, page_id: Column) -> Column:
    return F.concat(prefix, F.lit("?curid="), page_id.cast("string"))


def revision_url(wiki: Column, revision: Column) -> Column:
    return F.concat(F.lit("http://"), wiki, F.lit(".wikipedia.org/w/api.php?action=query&prop=revisions&format=json&rvprop=content&revids="), revision.cast("string"))


def filename_safe(name: Column, longest: int = 200) -> Column:
    return F.regexp_replace(F.substring(name, 1, longest), r"\W+", ".")


def title_key(title: Column) -> Column:
    """A title from a work-list: percent escapes decoded, underscores as spaces."""
    return F.replace(F.coalesce(F.try_url_decode(title), title), F.lit("_"), F.lit(" "))


def normalize_title(title: Column) -> Column:
    """Trim and collapse underscores and spaces; capitalise the first letter, of a namespace and of what follows it."""
    bare = F.regexp_replace(F.regexp_replace(title, r"[\s_]+", " "), r"^ | $", "")
    first = lambda c: F.concat(F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c)))
    space = F.trim(F.split_part(bare, F.lit(":"), F.lit(1)))
    rest = F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
    return F.when(F.contains(bare, F.lit(":")), F.concat(F.initcap(F.lower(space)), F.lit(":"), first(rest))).otherwise(first(bare))


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


@functools.lru_cache(maxsize=None)
def ascii_letter(c: str) -> str:
    """A letter that has no decomposition, by its name: the letter that a sign is put on, or the first letters of what it is called."""
    name = unicodedata.name(c, "")
    if "SHARP S" in name:
        return "ss"
    called = name.partition(" LETTER ")[2] or name.partition(" LIGATURE ")[2]
    base = called.partition(" WITH ")[0].split(" ")[-1][:3]
    return base.lower() if "SMALL" in name or "CAPITAL" not in name else base.capitalize()


def ascii_of(text: str) -> str:
    return "".join(c if c < "\x80" else ascii_letter(c) for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Letters without their marks and in ASCII, as a fold key for titles; letters of other scripts by their names."""
    return text.map(lambda s: None if s is None else ascii_of(s))
