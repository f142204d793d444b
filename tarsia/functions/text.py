"""Text normalisers and token features as column expressions. The four normalisers differ on purpose."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Hangul syllables decompose into letters by rule; they are left as they are.
HANGUL = range(0xAC00, 0xD7A4)


@cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of characters once combining marks are dropped.

    Characters that become one character, these characters, then marks that go; and those
    that become several, with what they become.
    """
    one, to, gone, more = [], [], [], {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        if code in HANGUL or unicodedata.category(c) in ("Cn", "Cs", "Co"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            one.append(c)
            to.append(plain)
        else:
            more[c] = plain
    return "".join(one + gone), "".join(to), more


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _class_of(chars: str) -> str:
    """A character class of these characters, neighbours as ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-2, *codes[:-1]], strict=True) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if after != c + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def strip_accents(c: Column) -> Column:
    """Letters without their accents, in any script, and compatibility forms as plain characters."""
    one, to, more = foldings()
    # few texts hold a character that becomes several; only those are taken apart
    table = F.from_json(F.lit(json.dumps(more)), "map<string, string>")
    apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    rare = F.when(c.rlike(_class_of("".join(more))), apart).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(rare, one, to)).otherwise(c)


def search_text(c: Column) -> Column:
    """For questions and search: no accents, lower case, letters and digits only."""
    c = F.replace(F.lower(strip_accents(_text(c))), F.lit("€"), F.lit(" euro "))
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def gate_text(c: Column) -> Column:
    """For incoming titles: keeps Italian accents and measures' marks."""
    c = F.replace(F.lower(_text(c)), F.lit("usb-c"), F.lit("usbc"))
    return squeeze(F.regexp_replace(c, "[^a-z0-9àèéìòù\\s,.\"'”″-]", " "))


def audit_text(c: Column) -> Column:
    """For duplicate keys: keeps Italian accents."""
    return squeeze(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9àèéìòù\s]", " "))


def match_text(c: Column) -> Column:
    """For matching products: capacities and screen sizes become one token."""
    c = F.regexp_replace(F.lower(_text(c)), r"\b(\d+(?:[,.]\d+)?)\s*(gb|tb)\b", " $1$2 ")
    c = F.regexp_replace(c, r"\b(\d{1,3}),(\d+)\s*(?:\"|”|″|'{1,2}|pollici|inch)", " $1.$2inch ")
    c = F.regexp_replace(c, r"\b(\d{1,3}(?:\.\d+)?)\s*(?:\"|”|″|'{1,2}|pollici|inch)", " $1inch ")
    for old, new in (("playstation 5", "ps5"), ("usb-c", "usbc"), ("usb c", "usbc")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return squeeze(F.regexp_replace(c, r"[^a-z0-9àèéìòù\s.]", " "))


def search_term(c: Column) -> Column:
    """A term that is safe to search for: word characters and hyphens of any script."""
    return squeeze(F.replace(F.regexp_replace(_text(c), r"(?U)[^\w\s-]", " "), F.lit("_"), F.lit(" ")))


def words(c: Column) -> Column:
    """Blank-separated parts of a squeezed text, none for an empty one."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def without(tokens: Column, drop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*drop))


def within(tokens: Column, keep: tuple[str, ...]) -> Column:
    """Distinct tokens of a vocabulary, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isin(*keep))))


def canonical_key(name: Column) -> Column:
    """The key under which a product is stored: fillers dropped, words joined by hyphens."""
    c = F.lower(_text(name))
    for old, new in vocab.KEY_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = squeeze(F.regexp_replace(c, r"[^a-z0-9àèéìòù\s]", " "))
    return F.array_join(without(words(c), vocab.KEY_FILLERS), "-")


def search_blob(name: Column, keywords: Column, category: Column) -> Column:
    return search_text(F.concat_ws(" ", name, keywords, category))


def similar_key(name: Column) -> Column:
    """Products of equal keys look alike in a list: colours and stopwords dropped, ten tokens."""
    return F.array_join(F.slice(without(words(search_text(name)), vocab.COLOURS + vocab.STOPWORDS), 1, 10), " ")


def shortened(c: Column, most: int = 120) -> Column:
    c = squeeze(_text(c))
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 3))), F.lit("..."))).otherwise(c)


def label(*parts: Column) -> Column:
    """Parts that aren't empty, separated by bars."""
    return F.array_join(F.filter(F.array(*[_text(p) for p in parts]), lambda p: p != ""), " | ")


def tokens_for_gate(title: Column) -> Column:
    parts = F.transform(words(gate_text(title)), lambda t: F.btrim(t, F.lit(".,-'\"”″")))
    return F.filter(parts, lambda t: t != "")


def has_term(text: Column, term: str) -> Column:
    """The phrase occurs, or the single word as a whole token."""
    if not term:
        return F.lit(False)
    return F.contains(text, F.lit(term)) if " " in term else F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {term} "))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)).otherwise(0.0)
