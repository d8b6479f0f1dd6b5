"""Text expressions: words, token estimates, tokens, sentences, ids. All stay inside Catalyst."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the ends of sentences.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same in two parts, as Java looks up characters below 256 of a class that has no others in a table, the rest one by one.
WS_NARROW = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0]"
WS_WIDE = r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENTENCE_END = r"(?<=[.!?。！？])" + WS + r"+|\n{2,}"
# Fixed value: runs of ASCII letters, of Sinhala letters and joiners, or of digits.
TOKEN = r"([a-zA-Z]{%d,}|[\x{0D80}-\x{0DFF}\x{200D}]{%d,}|(?U)\d{%d,})"
JOINER = r"\x{200D}"


def strip(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


#: Lower-case letters whose case folding is another text, such as ``ß`` and the final sigma, by the rule of the language.
FOLDED = {c: c.casefold() for k in range(0x80, 0x20000) if not 0xD800 <= k < 0xE000 and (c := chr(k)).lower() == c and c.casefold() != c}
_FOLDED = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in FOLDED) + "]"


def casefold(text: Column) -> Column:
    """``text`` for comparison whatever its case. Letters are looked up one by one only in a text that has such a letter."""
    low = F.lower(text)
    table = F.create_map(*[F.lit(x) for pair in FOLDED.items() for x in pair])
    each = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(low.rlike(_FOLDED), each).otherwise(low)


def blank_to_null(text: Column) -> Column:
    """Null where ``text`` is null, empty or only white space; else ``text`` as it is. The look ends at the first other
    character, where stripping goes through the whole text."""
    return F.when(text.rlike(f"[^{WS[1:]}"), text)


def words(text: Column) -> Column:
    """Parts between white space; a null text has none. White space above U+00FF is made plain first, and looked for only
    in a text with characters from U+1680 to U+3000."""
    plain = F.when(text.rlike(r"[\x{1680}-\x{3000}]"), F.regexp_replace(text, WS_WIDE, " ")).otherwise(text)
    return F.filter(F.split(F.coalesce(plain, F.lit("")), WS_NARROW + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many parts stand between white space; a null text has none. (Counting matches of the negated class takes Java
    five times as long as splitting.)"""
    return F.size(words(text))


def normalise_space(text: Column) -> Column:
    return F.array_join(words(text), " ")


def token_estimate(text: Column) -> Column:
    """0 for an empty or null text, else words x 1.35 + non-ASCII characters / 4, at least 1."""
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7f]+", ""))
    estimate = (word_count(text) * F.lit(1.35) + foreign / F.lit(4.0)).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), estimate))


def tokens(text: Column, min_length: int = 2) -> Column:
    """Lower-case tokens of at least ``min_length`` characters, in order; a null text has none. Joiners at the ends of
    tokens are looked for only in a text that has joiners."""
    least = max(1, min_length)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN % (least, least, least)), F.lit(1))
    trimmed = F.filter(F.transform(found, lambda t: F.regexp_replace(t, f"^{JOINER}+|{JOINER}+$", "")), lambda t: F.length(t) >= min_length)
    return F.when(F.contains(text, F.lit("\u200d")), trimmed).otherwise(found)


def counted_words(text: Column) -> Column:
    """How many words hold a letter or digit."""
    return F.size(F.filter(words(text), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def counts_words(text: Column, least: int) -> Column:
    """Whether at least ``least`` words hold a letter or digit. The look ends with the last of these, where a count goes
    through the whole text."""
    word = rf"[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}][^{WS[1:]}*+"
    return F.coalesce(text, F.lit("")).rlike(rf"\A(?:{word}){{{max(0, least)}}}")


def sentences(text: Column) -> Column:
    """Stripped, non-blank sentences."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def lesson_number(heading: Column) -> Column:
    """The number that begins a heading such as ``3 Energy``; null without one."""
    return F.regexp_extract(heading, r"^\s*(\d+)\s+(.+)$", 1).try_cast("int")


def lesson_title(heading: Column) -> Column:
    """The heading without its number, stripped."""
    rest = strip(F.regexp_extract(heading, r"(?s)^\s*\d+\s+(.+)$", 1))
    return F.when(rest != "", rest).otherwise(strip(heading))


def citation_id(chunk_id: Column) -> Column:
    """``C-`` and the first ten hex digits of the id's SHA-256, in capitals."""
    return F.concat(F.lit("C-"), F.upper(F.substring(F.sha2(chunk_id.cast("string"), 256), 1, 10)))


def catalogue_version(titles: Column) -> Column:
    """First twelve hex digits of the SHA-256 of the titles joined by line ends."""
    return F.substring(F.sha2(F.array_join(titles, "\n"), 256), 1, 12)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID (version 5, RFC 9562) of ``name``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name.cast("string"), "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.lower(F.lpad(F.hex(F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


#: The namespace of chunk and point ids; any fixed UUID does.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quern:chunks")


def chunk_id(doc_id: Column, unit: Column, kind: Column, ordinal: Column) -> Column:
    """The same id for the same place of the same document, whenever it is made."""
    return uuid5(NAMESPACE, F.concat_ws(":", *[c.cast("string") for c in (doc_id, unit, kind, ordinal)]))


def point_id(chunk: Column) -> Column:
    """The key under which a chunk is stored."""
    return uuid5(NAMESPACE, chunk)


def jaccard(a: Column, b: Column) -> Column:
    """Share of the common among all distinct items of two arrays; 0 where both are empty."""
    together = F.size(F.array_union(a, b))
    return F.when(together > 0, F.size(F.array_intersect(a, b)) / together).otherwise(F.lit(0.0))


def content_hash(text: Column) -> Column:
    """SHA-256 of the case-folded words joined by one space: equal for texts that differ in case, signs or spaces."""
    found = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"((?U)[\w\x{0D80}-\x{0DFF}]+)"), F.lit(1))
    return F.sha2(F.array_join(found, " "), 256)


def render(template: str, variables: dict[str, Column]) -> Column:
    """``template`` with each ``{{name}}`` replaced. A name without a value is an error when the query is built."""
    pieces: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        if m[1] not in variables:
            raise KeyError(f"the template needs {m[1]!r}")
        pieces += [F.lit(template[at : m.start()]), F.coalesce(variables[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def markdown_cell(text: Column) -> Column:
    """A table cell with its bars escaped; a null one is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def unfence(text: Column) -> Column:
    """``text`` without what could pass for markup of a prompt: tags, and roles at the beginning of a line."""
    return F.regexp_replace(F.regexp_replace(text, r"</?[A-Za-z_][\w-]*>", ""), r"(?im)^\s*(system|assistant|user|tool)\s*:", "")


def object_of(text: Column) -> Column:
    """The JSON object in ``text``: the whole, or what stands from the first ``{`` to the last ``}``; else null."""
    whole = F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner))
