"""Tokenizers and cleaners: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqspark.consts import BPE_MARK, GENERAL_MOLECULE_PATTERN, SHORT_UNITS

# Fixed value: the characters Unicode text handling counts as white space.
WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Typographic characters and their plain forms.
QUOTES_FROM = "‘’‚“”„«»–—… "
QUOTES_TO = "'''\"\"\"\"\"--. "


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def words(line: Column) -> Column:
    """White-space tokens; empty array for a blank line."""
    return F.filter(F.split(line, f"{WHITE}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def short_molecule(text: Column) -> Column:
    """One character per token, except for the two-character units."""
    return F.regexp_extract_all(strip(text), F.lit("(?s)" + "|".join(SHORT_UNITS) + "|."), F.lit(0))


def general_molecule(text: Column) -> Column:
    return F.regexp_extract_all(strip(text), F.lit(GENERAL_MOLECULE_PATTERN), F.lit(0))


def is_lossless(text: Column, tokens: Column) -> Column:
    """True when the tokens spell the stripped text; other rows belong in quarantine."""
    return F.array_join(tokens, "") == strip(text)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def lower(text: Column) -> Column:
    return F.lower(text)


def drop_metadata(line: Column, tags: list[str]) -> Column:
    """Predicate: the line opens none of the metadata tags."""
    return ~line.rlike("|".join(f"<{t}>" for t in tags))


def unwrap_tags(line: Column, tags: list[str]) -> Column:
    """Remove the named opening and closing tags, keep what they enclose."""
    return F.regexp_replace(line, "|".join(f"</?{t}( [^>]*)?>" for t in tags), "")


def has_tag(line: Column, tag: str) -> Column:
    return line.rlike(f"<{tag}[ >]")


def inner_text(line: Column, tag: str) -> Column:
    """Trimmed text between the opening tag and its end tag."""
    return F.trim(F.regexp_extract(line, f"<{tag}[^>]*>(.*?)</{tag}>", 1))


def straighten_apostrophe(line: Column) -> Column:
    return F.regexp_replace(line, "’", "'")


def printable(line: Column) -> Column:
    """Control, format and unassigned characters become spaces."""
    return F.regexp_replace(line, "\\p{C}", " ")


def plain_punctuation(line: Column) -> Column:
    return F.translate(line, QUOTES_FROM, QUOTES_TO)


def first_words(line: Column, n: int) -> Column:
    return F.array_join(F.slice(words(line), 1, n), " ")


def remove_bpe(sentence: Column, mark: str = BPE_MARK + " ") -> Column:
    """Join marked pieces: ``he@@ llo`` becomes ``hello``."""
    return F.rtrim(F.replace(F.concat(sentence, F.lit(" ")), F.lit(mark), F.lit("")))


def byte_ids(word: Column, width: int = 50) -> Column:
    """UTF-8 bytes plus one, truncated or zero-padded to a fixed width."""
    codes = F.transform(
        F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0)),
        lambda h: F.conv(h, 16, 10).cast("int") + 1,
    )
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)


def byte_length(word: Column) -> Column:
    return F.octet_length(word)
