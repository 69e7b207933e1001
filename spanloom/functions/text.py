"""Column functions on texts: normalising, counting, hashing, cutting."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters whose ASCII form is not their base letter.
SPECIAL = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "Ł": "L", "ł": "l", "ı": "i",
    "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "•": "*", "×": "x", "÷": "/", "\xa0": " ", "«": "<<", "»": ">>", "¡": "!", "¿": "?",
    "€": "EUR", "£": "PS", "¥": "Y=", "©": "(c)", "®": "(r)", "°": "deg", "§": "SS", "¶": "P", "±": "+-", "·": "*", "µ": "u",
}
#: Greek and Cyrillic letters; capitals follow from the small ones.
SCRIPTS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s",
    "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "i", "ґ": "g",
}
#: The parts that Unicode composes a Hangul syllable of, first, middle and last.
HANGUL = (
    "g gg n d dd r m b bb s ss - j jj c k t p h".replace("-", "").split(" "),
    "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" "),
    " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" "),
)
SPACE = r"[\s\x1c-\x1f]+"


def _ascii(s: str) -> str:
    return "".join(c for c in s.replace("\u2044", "/") if c.isascii())


@lru_cache(maxsize=1)
def transliteration() -> dict[str, str]:
    """ASCII forms, by rule where there is one: letters by their canonical decomposition, forms that stand for others (fractions,
    ligatures, superscripts, full widths) by the compatible one, and kana by their names. Pass another table for other scripts."""
    out = dict(SPECIAL)
    for k, v in SCRIPTS.items():
        out[k] = v
        if k.upper() != k:
            out.setdefault(k.upper(), v.capitalize())
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x2000), *range(0x370, 0x500)):
        base = unicodedata.normalize("NFD", chr(i))[0]
        if chr(i) not in out and (base.isascii() or base in out):
            out[chr(i)] = out.get(base, base)
    for i in (*range(0xA0, 0x100), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKC", chr(i))
        if chr(i) not in out and plain != chr(i) and (found := _ascii(plain)):
            out[chr(i)] = found
    for i in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)):
        out[chr(i)] = unicodedata.name(chr(i)).rpartition(" ")[2].lower()
    # what is composed otherwise first: a letter and its mark, where the letter alone is written another way
    pairs = {unicodedata.normalize("NFD", k): v for k, v in out.items() if len(unicodedata.normalize("NFD", k)) == 2}
    return {k: v for k, v in pairs.items() if v != out.get(k[0], k[0])} | out


#: Blocks of characters whose longer forms are looked up one by one.
BLOCKS = ((0xA0, 0x250), (0x370, 0x500), (0x1E00, 0x2000), (0x2070, 0x2190), (0x3041, 0x30FB), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def _list(values: list[str]) -> Column:
    """Fixed strings as one constant array."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _other(table: dict[str, str]):
    """What becomes of a piece, which is a run of ASCII or another character: its form in a block of the table; a Hangul syllable by
    its parts; any other letter by its number and a space; marks and signs as nothing."""

    def one(c: Column) -> Column:
        at = F.ascii(c)
        out = F.when(at < 0x80, c)
        for low, high in BLOCKS:
            forms = [table.get(chr(i), "\x00") for i in range(low, high)]
            if any(x != "\x00" for x in forms):
                form = F.get(_list(forms), at - low)
                out = out.when((at >= low) & (at < high) & (form != "\x00"), form)
        s = at - 0xAC00
        part = lambda k, i: F.get(_list(HANGUL[k]), i.cast("int"))
        syllable = F.concat(part(0, F.floor(s / 588)), part(1, F.floor(s % 588 / 28)), part(2, s % 28))
        letter = F.concat(F.lit("u"), F.lower(F.hex(at)), F.lit(" "))
        return out.when((s >= 0) & (s < 11172), syllable).when(c.rlike(r"^[\p{L}\p{N}]$"), letter).otherwise("")

    return one


def squash(c: Column | str) -> Column:
    """Each run of white space as one space; the ends are not stripped."""
    return F.regexp_replace(c, SPACE, " ")


def to_ascii(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """Transliterated text. Letters that the table does not have are written by a rule, so that they still tell words apart;
    other characters are dropped. Combining marks go too, and letters composed of several characters are in the table."""
    table = transliteration() if table is None else table
    one = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    source = F.col(c) if isinstance(c, str) else c
    composed = source
    rare = [k for k in table if len(k) > 1 or k not in one and not any(low <= ord(k) < high for low, high in BLOCKS)]
    for k in sorted(rare, key=lambda x: -len(x)):
        composed = F.replace(composed, F.lit(k), F.lit(table[k]))
    if rare:  # each of them ends in a mark or a character that hardly any text has
        composed = F.when(source.rlike("[" + "".join(sorted({f"\\x{{{ord(k[-1]):x}}}" for k in rare})) + "]"), composed).otherwise(source)
    # most texts are ASCII already, and most others once each letter is its base letter; the rest goes by pieces
    plain = lambda x: F.octet_length(x) == F.length(x)
    pieces = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), 0), _other(table)), "")
    based = F.translate(composed, "".join(one), "".join(one.values()))
    return F.when(plain(source), source).otherwise(_let(based, lambda x: F.when(plain(x), x).otherwise(pieces(x))))


def norm_text(c: Column | str, table: dict[str, str] | None = None, strict: bool = False) -> Column:
    """ASCII with single spaces. ``strict`` turns null into the text None; by default null stays null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    out = squash(to_ascii(text, table))
    return F.coalesce(out, F.lit("None")) if strict else out


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no built-in for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def len_preserved(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(norm_text(c)) == F.length(c))
    return out


def words(c: Column | str) -> Column:
    """Non-empty pieces between white space."""
    return F.array_remove(F.split(squash(c), " "), "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def find(haystack: Column | str, needle: Column | str) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none."""
    h, n = (F.col(x) if isinstance(x, str) else x for x in (haystack, needle))
    return F.when(n == "", 0).otherwise(F.position(n, h) - 1)


def cut(c: Column | str, start: Column, length: Column) -> Column:
    return F.substring(c, start + 1, length)


def short_hash(c: Column | str, n: int = 7) -> Column:
    return F.substring(F.sha2(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"), 256), 1, n)


def pair_key(source: str = "source", target: str = "target") -> Column:
    """Twelve hex digits that name a pair by its texts, whatever the spaces around the target."""
    return short_hash(F.concat(F.col(source), F.lit("\n---\n"), F.trim(F.col(target))), 12)


def bucket_of(c: Column, n: Column) -> Column:
    """A number under ``n`` from the text of ``c``, the same in any engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), n).cast("int")
