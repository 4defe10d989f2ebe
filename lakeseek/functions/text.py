"""Text expressions: lines, trimming, full-text tokens, hashes, token estimates."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line for str.splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


def lines(text: Column) -> Column:
    """Lines of a text, without a last empty one; the empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def strip(text: Column) -> Column:
    """Without white space (in Unicode's sense, and the ASCII separators) at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


@functools.cache
def _accents() -> tuple[str, str]:
    """Lower-case letters that are a base letter and one mark, and those base letters; by decomposition rule."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if char.lower() == char and len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isalpha():
            marked.append(char)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters, numbers and private-use characters, lower case, single accents removed."""
    return F.filter(F.split(F.translate(F.lower(text), *_accents()), NOT_TOKEN), lambda t: t != "")


def token_line(text: Column) -> Column:
    """The full-text tokens as one string, each with a space on both sides: " a  b "; the empty string without tokens."""
    spaced = F.trim(F.regexp_replace(F.translate(F.lower(text), *_accents()), NOT_TOKEN, "  "))
    return F.when(spaced == "", F.lit("")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def phrases(query: str) -> list[list[str]]:
    """A query's phrases: white space parts, each cut into adjacent tokens; a quote makes the query match nothing."""
    import re

    table = str.maketrans(*_accents())
    if '"' in query:
        return []
    out = []
    for part in query.split():
        word = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in part.lower().translate(table))
        got = re.findall(r"\S+", word)
        if got:
            out.append(got)
    return out


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with Windows line ends made Unix ones."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def decode_utf8(content: Column) -> Column:
    """Bytes to text, leaving out what is not UTF-8; replacement characters that a file really has stay.

    They are set aside, as an escape of a noncharacter, while what is invalid becomes a replacement character and goes.
    """
    out = content.cast("string")
    for real, aside in (("\ufdd0", "\ufdd0a"), ("\ufffd", "\ufdd0b")):
        out = F.replace(out, F.lit(real), F.lit(aside))
    out = F.replace(F.make_valid_utf8(out), F.lit("\ufffd"), F.lit(""))
    for real, aside in (("\ufffd", "\ufdd0b"), ("\ufdd0", "\ufdd0a")):
        out = F.replace(out, F.lit(aside), F.lit(real))
    return out


def has_nul(content: Column) -> Column:
    return F.instr(F.decode(content, "ISO-8859-1"), "\0") > 0


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit("\\n")), 1, size)


def token_estimate(text: Column, per: int = 3) -> Column:
    """At least 1 for a text that is not empty: characters over `per`."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / per))).cast("long")


def truncate_to_tokens(text: Column, most: int) -> Column:
    room = max(0, most * 3 - 20)
    return F.when(F.length(text) > most * 3, F.concat(F.substring(text, 1, room), F.lit("\n[...truncated...]"))).otherwise(text)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; a missing part reads None."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256)


def set_hash(hashes: Column) -> Column:
    """SHA-256 of a set of hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), "|"), 256)
