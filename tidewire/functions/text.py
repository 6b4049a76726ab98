"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, for use inside a class. Single
# characters below 256 share one table lookup and the wide ones are tested only
# inside their range, which is several times faster than a list of ranges.
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
WS_INLINE = r" \t\r\f\x0B\x1C\x1D\x1E\x1F\x{85}\x{A0}" + _WIDE   # without the line feed
WS = r"\n" + WS_INLINE
CJK = r"[\x{4E00}-\x{9FFF}]"
# the same characters, for functions that take them as a string
WS_CHARS = "\n \t\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# ---- fixed values -----------------------------------------------------------
SENTENCE_MARKS = "。！？!?."
WIDE_PUNCTUATION = "。，！？：；“”‘’（）"
ASCII_PUNCTUATION = ".,!?:;\"\"''()"
CHINESE_DIGITS = "一二三四五六七八九零〇"
ARABIC_DIGITS = "12345678900"
WORDS_TO_TOKENS = 1.3
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]
# ---- end of fixed values ----------------------------------------------------

# A character class of the sentence marks, the wide ones behind one range test.
_WIDE_MARKS = "".join(c for c in SENTENCE_MARKS if ord(c) > 127)
MARKS = ("".join(c for c in SENTENCE_MARKS if ord(c) <= 127)
         + rf"[\x{{{ord(min(_WIDE_MARKS)):X}}}-\x{{{ord(max(_WIDE_MARKS)):X}}}&&[{_WIDE_MARKS}]]")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def clean_text(text: Column) -> Column:
    """One line feed between non-empty, stripped lines."""
    unified = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(unified, rf"(?<![{WS_INLINE}])[{WS_INLINE}]*\n[{WS}]*", "\n"))


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(markup: Column) -> Column:
    """Text pieces between tags, each stripped, joined by one space."""
    quiet = F.regexp_replace(
        F.coalesce(markup, F.lit("")),
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!doctype[^>]*>", "\u0001")
    pieces = F.split(F.regexp_replace(quiet, r"</?[A-Za-z][^>]*>", "\u0001"), "\u0001")
    shown = F.transform(pieces, lambda p: strip(decode_entities(p)))
    return F.array_join(F.filter(shown, lambda p: p != ""), " ")


def noise_ratio(text: Column, markup: Column) -> Column:
    share = (F.length(markup) - F.length(text)) / F.length(markup)
    missing = (F.coalesce(F.length(markup), F.lit(0)) == 0) | (F.coalesce(F.length(text), F.lit(0)) == 0)
    return F.when(missing, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{WS}]+"))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def _scaled(words: Column) -> Column:
    return F.floor(words * F.lit(WORDS_TO_TOKENS))


def mixed_tokens(text: Column) -> Column:
    return F.coalesce(cjk_count(text) + _scaled(word_count(F.regexp_replace(text, CJK, ""))), F.lit(0)).cast("bigint")


def estimate_tokens(text: Column, lang: Column) -> Column:
    """Token estimate by language: characters, words, or both."""
    size = (
        F.when(lang == "zh", F.length(text).cast("bigint"))
        .when(lang == "en", _scaled(word_count(text)).cast("bigint"))
        .otherwise(mixed_tokens(text))
    )
    return F.coalesce(size, F.lit(0)).cast("bigint")


def detect_language(text: Column) -> Column:
    shown = F.length(strip(text))
    share = cjk_count(text) / shown
    return (
        F.when(F.coalesce(shown, F.lit(0)) == 0, "zh")
        .when(share > 0.7, "zh").when(share < 0.3, "en").otherwise("mixed")
    )


def split_semantic(text: Column) -> Column:
    """Paragraphs at blank lines; a single paragraph is cut into sentences.

    Only a text with two line feeds in a row can have several paragraphs.
    """
    body = strip(F.coalesce(text, F.lit("")))
    paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}"), strip), lambda p: p != "")
    sentences = F.regexp_extract_all(
        text, F.lit(rf"[^{MARKS}]*[{MARKS}][{WS}]*|[^{MARKS}]+$"), F.lit(0))
    shown = F.filter(sentences, lambda s: strip(s) != "")
    several = F.contains(text, F.lit("\n\n"))
    return (F.when(several & (F.size(paragraphs) != 1), paragraphs).when(several | (body != ""), shown)
            .otherwise(F.array().cast("array<string>")))


def normalize_fact(fact: Column) -> Column:
    """Comparable form of a fact: ASCII punctuation and digits, single spaces.

    Most facts need none of the replacements, so each is asked for first, in one cheap search.
    """
    text = strip(F.coalesce(fact, F.lit("")))
    odd = text.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[{WIDE_PUNCTUATION}{CHINESE_DIGITS}十]]|[{WS}&&[^ ]]|  |[0-9] [0-9]")
    spaced = F.regexp_replace(F.translate(text, WIDE_PUNCTUATION, ASCII_PUNCTUATION), rf"[{WS}]+", " ")
    plain = F.replace(F.translate(spaced, CHINESE_DIGITS, ARABIC_DIGITS), F.lit("十"), F.lit("10"))
    plain = F.regexp_replace(plain, r"([1-9])\s+1(0)|(0)\s+10", "$1$2$3")
    return F.when(odd, F.regexp_replace(plain, r"(?<=\d)\s+(?=\d)", "")).otherwise(text)


def edit_similar(left: Column, right: Column, above: float = 0.85, max_len: int = 50) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    share = F.lit(1.0) - F.levenshtein(left, right) / longest
    short = (F.length(left) < max_len) & (F.length(right) < max_len)
    return F.when(short & (longest > 0), share > above).otherwise(F.lit(False))


def preview(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def percent(value: Column) -> Column:
    return F.format_string("%.0f%%", value * 100)


def token_amount(tokens: Column) -> Column:
    """n, n.nK or n.nM."""
    return (
        F.when(tokens < 1000, tokens.cast("string"))
        .when(tokens < 1_000_000, F.format_string("%.1fK", tokens / 1000))
        .otherwise(F.format_string("%.1fM", tokens / 1_000_000))
    )


def money(amount: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", amount)
