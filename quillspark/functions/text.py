"""Text functions as Column expressions: headline repair, keyword predicates, cleaning, tokens, excerpts."""

from __future__ import annotations

import re
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character references and their characters, replaced in this order.
ENTITIES = [
    ("&apos;", "'"), ("&#039;", "'"), ("&#39;", "'"), ("&#8217;", "'"), ("&#8216;", "'"), ("&quot;", '"'), ("&#034;", '"'), ("&#8220;", '"'), ("&#8221;", '"'), ("&amp;", "&"), ("&#8230;", "..."),
]
NO_WORD_AFTER = "(?![0-9A-Za-z_])"
# References that lost their marks and grew together with a word (group references as in Java).
GLUED = [
    (r"apos([A-Z])", r"'$1"), (r"([A-Za-z])apos(s|t|m|d|re|ve|ll)(?![0-9A-Za-z_])", r"$1'$2"), (r"([A-Za-z])apos(?![0-9A-Za-z_])", r"$1'"), (r"quot([A-Z])", r'"$1'), (r"([A-Za-z.,!?])quot(?![0-9A-Za-z_])", r'$1"'),
]
# Word lists of the text features.
ATTRIBUTION = [
    r"according\s+to", "said", "says", "told", "reported", "stated", "wrote", "added", "noted", "confirmed",
    "announced", "testified", "acknowledged",
]
HEDGES = [
    "might", "could", "reportedly", "allegedly", "apparently", "seemingly", "suggests", r"appears\s+to", "possibly",
    "perhaps", "likely", r"some\s+say",
]
CERTAINTY = [
    "clearly", "obviously", "undeniable", "undeniably", "proves", "proven", "definitely", "certainly",
    r"without\s+question", r"no\s+doubt", "absolutely", "indisputable",
]
FUNCTION_WORDS = [
    "would", "could", "may", "might", "must", "shall", "cannot", "ought", "also", "going", "gonna", "get", "gets",
    "got", "getting", "like", "us", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "hundred", "thousand", "million", "billion", "trillion", "first", "second", "third", "last",
]
FEATURE_WORDS = [
    "according", "said", "says", "told", "reported", "stated", "wrote", "added", "noted", "confirmed", "announced",
    "testified", "acknowledged", "might", "could", "may", "reportedly", "allegedly", "apparently", "seemingly",
    "suggests", "appears", "possibly", "perhaps", "likely", "clearly", "obviously", "undeniable", "undeniably",
    "proves", "proven", "definitely", "certainly", "absolutely", "indisputable",
]
CAPS_BOILERPLATE = [
    "related", "read", "click", "donate", "trending", "subscribe", "advertisement", "share", "follow", "newsletter",
    "news", "watch", "video", "update", "updated", "breaking", "exclusive", "editor", "note", "photo", "photos",
    "image", "source",
]
MASKS = r"(?i)<copyright>|<twitter>|<url>|(?<![\p{L}\p{N}_])<?selfref>?(?![\p{L}\p{N}_])"
MASKS_PLAIN = r"(?i)<copyright>|<twitter>|<url>|<?selfref>?"
WORD = r"[A-Za-z]+(?:['\-][A-Za-z]+)*"
LINE_END = ".!?:;,\"')]”"
ARTEFACTS = {"has_quote_mark": '["“”]', "apos_artifact": r"apos[A-Z]|[a-z]apos(s|t|re|ve|ll|d)(?![0-9A-Za-z_])|Iaposm", "quot_artifact": r"quot[A-Z]|[a-z.,!?]quot(?![0-9A-Za-z_])", "html_entity": r"&(quot|apos|amp|#[0-9]+);"}
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def repaired(title: Column) -> Column:
    """A headline with references restored, in lower case; null becomes empty."""
    e = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ENTITIES, F.coalesce(title, F.lit("")))
    return F.lower(reduce(lambda c, x: F.regexp_replace(c, x[0], x[1]), GLUED, e))


def term_pattern(terms: list[str], plural: frozenset[str] = frozenset()) -> str:
    """One pattern for all terms, longest first; an ASCII word border only beside a word character; an optional plural s for names."""
    ascii_word = re.compile(r"[0-9A-Za-z_]")
    parts = []
    for t in sorted(set(terms), key=lambda t: (-len(t), t)):
        left = r"(?<![0-9A-Za-z_])" if ascii_word.match(t[0]) else ""
        right = r"(?![0-9A-Za-z_])" if ascii_word.match(t[-1]) else ""
        parts.append(left + re.escape(t) + ("s?" if t in plural else "") + right)
    return "(?:" + "|".join(parts) + ")"


def pattern_terms(pattern: str) -> list[str]:
    """The terms of a pattern that term_pattern made."""
    body = pattern.removeprefix("(?:").removesuffix(")")
    parts = re.split(r"(?<!\\)\|", body)
    return [re.sub(r"\\(.)", r"\1", p.replace(r"(?<![0-9A-Za-z_])", "").replace(r"(?![0-9A-Za-z_])", "").removesuffix("s?")) for p in parts]


def about(title: Column, terms: list[str]) -> Column:
    """Whether a headline has one of the terms, after repair."""
    return repaired(title).rlike(term_pattern(terms))


def normal_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def letters_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def named_references() -> dict[str, str]:
    """What each named character reference stands for, with and without a semicolon, by the standard library's table."""
    from html.entities import html5

    return html5


def _code_point(n: Column) -> Column:
    """The text of a numeric reference: what the standard reads into bytes of Windows-1252, nothing for what it forbids."""
    from html import unescape

    odd = {i: unescape(f"&#{i};") for i in [*range(0x20), *range(0x7F, 0xA0)]}
    table = F.create_map(*[F.lit(x) for i, c in odd.items() for x in (i, c)])
    n = n.cast("long")
    bad = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(none, "").when((n < 0x20) | n.between(0x7F, 0x9F), F.element_at(table, n.cast("int"))).otherwise(plain)


def unescaped(c: Column) -> Column:
    """Text with all character references decoded, in one pass: named (the longest known name counts, where the semicolon is
    missing), decimal and hexadecimal. What is no reference stays; what a reference stands for is not read again."""
    names = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")  # constant, so it is made once
    short = sorted({len(x) for x in named_references() if not x.endswith(";")}, reverse=True)

    def one(p: Column) -> Column:
        number, name = F.regexp_extract(p, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0), F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0)
        digits = F.regexp_replace(F.regexp_extract(number, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
        # more digits than any code point has are past them all
        value = F.when(number.rlike("^#[xX]"), F.conv(F.left(digits, F.lit(8)), 16, 10)).otherwise(F.left(digits, F.lit(10))).cast("long")
        known = F.coalesce(*[F.when(F.length(name) >= k, F.concat(names[F.left(name, F.lit(k))], F.substr(p, F.lit(k + 1)))) for k in short])
        named = F.coalesce(F.concat(names[name], F.substr(p, F.length(name) + 1)), known, F.concat(F.lit("&"), p))
        return F.when(number != "", F.concat(_code_point(value), F.substr(p, F.length(number) + 1))).when(name != "", named).otherwise(F.concat(F.lit("&"), p))

    text = F.coalesce(c, F.lit(""))
    parts = F.split(text, "&", -1)
    done = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)), "")
    return F.when(F.contains(text, F.lit("&")), done).otherwise(text)


def cleaned(c: Column, masks: str = MASKS) -> Column:
    """Article text: references, straight apostrophes, masks out, a full stop after each line that ends in none."""
    text = F.regexp_replace(F.translate(unescaped(c), "’‘", "''"), masks, " ")
    lines = F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    ends = [F.lit(x) for x in LINE_END]
    return F.array_join(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.when(F.right(x, F.lit(1)).isin(*ends), x).otherwise(F.concat(x, F.lit(".")))), " ")


def masked(c: Column, masks: str = MASKS) -> Column:
    """How many masks the text has."""
    return F.regexp_count(unescaped(c), F.lit(masks))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


#: A word with what opens its sentence, if anything does; and a text that opens with a word.
OPENED = r"(?:(?:^|[.!?:;])[ \"'“(\[*]*)?" + WORD
STARTS = r"^[ \"'“(\[*]*[A-Za-z]"


def proper_flags(text: Column) -> Column:
    """Array of (w, initial, proper) for each word: a name is a word with a capital first letter inside a sentence, or a
    capitalised or all-caps word whose lower-case form was such a name elsewhere in the text."""
    first = F.regexp_extract_all(text, F.lit(OPENED), F.lit(0))
    pairs = F.transform(first, lambda x, i: F.struct(F.regexp_extract(x, f"({WORD})$", 1).alias("w"), (x.rlike("^[.!?:;]") | ((i == 0) & text.rlike(STARTS))).alias("initial")))
    title = lambda w: w.rlike("^[A-Z]") & (F.upper(w) != w)
    upper = lambda w: F.upper(w) == w
    names = F.array_distinct(F.transform(F.filter(pairs, lambda p: title(p["w"]) & ~p["initial"]), lambda p: F.lower(p["w"])))
    state = F.struct(pairs.alias("p"), names.alias("n"))
    done = F.transform(F.array(state), lambda s: F.transform(s["p"], lambda p: F.struct(p["w"].alias("w"), p["initial"].alias("initial"), ((title(p["w"]) | upper(p["w"])) & F.array_contains(s["n"], F.lower(p["w"]))).alias("proper"))))
    return F.element_at(done, 1)


def rate(text: Column, terms: list[str], tokens: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(f"(?i){LEFT}(?:{'|'.join(terms)}){RIGHT}")), tokens)


def hedging(text: Column, tokens: Column) -> Column:
    """Hedges and the lower-case verb may (not the month or a name) by token."""
    n = F.regexp_count(text, F.lit(f"(?i){LEFT}(?:{'|'.join(HEDGES)}){RIGHT}")) + F.regexp_count(text, F.lit(f"{LEFT}may{RIGHT}"))
    return F.try_divide(n, tokens)


def blinded(text: Column, outlet: Column, limit: int = 180) -> Column:
    """An excerpt that doesn't give the outlet away: masks and addresses out, its name replaced, cut at a sentence end."""
    t = F.regexp_replace(F.regexp_replace(unescaped(text), MASKS, " "), r"https?://\S+|www\.\S+", " ")
    name = F.concat(F.lit(r"(?i)\b"), F.array_join(F.transform(F.filter(F.split(outlet, ""), lambda c: c != ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), r"[\s\-.]?"), F.lit(r"\b"))
    t = F.when(F.length(outlet) >= 5, F.regexp_replace(t, name, F.lit("[outlet]"))).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    parts = F.split(t, " ")
    head = F.array_join(F.slice(parts, 1, limit), " ")
    cut = F.length(F.regexp_extract(head, r"^(?s)(.*[.!?]) ", 1))
    return F.when(F.size(parts) <= limit, t).otherwise(F.concat(F.when(cut - 1 > F.length(head) * 0.6, F.substring(head, F.lit(1), cut)).otherwise(head), F.lit(" [...]")))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; one at least."""
    w = F.lower(word)
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.rlike("[^aeiouyl]e$"), 1).otherwise(0))


def sentences(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+(?=\s|$|[\"')\]”])")))


def mtld_of(tokens: list[str], limit: float = 0.72) -> float | None:
    """Measure of textual lexical diversity of a token sequence, mean of both directions; None where no factor is made."""

    def one(ts: list[str]) -> float | None:
        factors, seen, n = 0.0, set(), 0
        for w in ts:
            seen.add(w)
            n += 1
            if len(seen) / n < limit:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - limit)
        return len(ts) / factors if factors else None

    both = one(tokens), one(tokens[::-1])
    return None if None in both else sum(both) / 2


def mtld(tokens: Column) -> Column:
    """The same as an Arrow UDF: each factor depends on where the last one ended, so it is a loop over the tokens."""
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: mtld_of(list(ts)) if ts is not None else None).astype("float64")

    return run(tokens)
