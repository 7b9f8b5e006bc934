"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import rules

JS_SPACE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_SPACES = JS_SPACE[1:-2]
# Runs of white space that aren't one blank already: most words stand one blank apart, and each replacement costs.
_UNEVEN_SPACE = f"[{_SPACES.replace(' ', '')}][{_SPACES}]*+| [{_SPACES}]++"
_ZERO_WIDTH = "[\u200b-\u200d\ufeff\u2060]"
_STRIPPED = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\u00ad]"
_TAGS = "[\U000e0000-\U000e007f]+"


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ZERO_WIDTH, "")


def norm_key(text: Column) -> Column:
    """The key under which equal content meets: without zero-width characters, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(without_zero_width(text), _UNEVEN_SPACE, " "))


def decode_tags(text: Column) -> Column:
    """The message in tag characters, as ASCII."""
    found = F.regexp_extract_all(text, F.lit("([\U000e0020-\U000e007e])"), F.lit(1))
    return F.array_join(F.transform(found, lambda c: F.char(F.ascii(c) - 0xE0000)), "")


def tag_messages(text: Column) -> Column:
    """The messages of eight characters or more in runs of tag characters, in order."""
    runs = F.regexp_extract_all(text, F.lit(f"({_TAGS})"), F.lit(1))
    return F.filter(F.transform(runs, decode_tags), lambda x: F.length(x) >= 8)


def hides(text: Column) -> Column:
    """Has the text characters that are stripped or folded before matching, or a message in tag characters?"""
    plain = F.regexp_replace(text, _TAGS, " ")
    return plain.rlike(_STRIPPED) | (fold_lookalikes(plain) != plain) | (F.size(tag_messages(text)) > 0)


def encode_tags(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, range(0x20, 0x7F))), "".join(chr(0xE0000 + k) for k in range(0x20, 0x7F)))


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, rules.LOOKALIKES, rules.LATIN)


def invisible_classes(text: Column) -> Column:
    """Names of the classes of invisible characters that occur, in fixed order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules.INVISIBLE]), lambda x: x.isNotNull())


def matching_text(text: Column) -> Column:
    """The text that rules are matched against, for input that is already in NFKC (see risk.nfkc for the rest)."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _TAGS, " "), _STRIPPED, "")
    plain = F.regexp_replace(fold_lookalikes(plain), "[\u3099\u309a]", "")
    plain = F.trim(F.regexp_replace(plain, JS_SPACE, " "))
    return F.regexp_replace(plain, "(?i)ignoreallpreviousinstructions", "ignore all previous instructions")


def utf16_length(text: Column) -> Column:
    """Characters, those beyond the basic plane twice."""
    return F.length(text) + F.regexp_count(text, F.lit("[\U00010000-\U0010ffff]"))


def excerpt(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def token_set(text: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z_]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def licence_name(value: Column) -> Column:
    """The normalised name of a licence."""
    x = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for pattern, by in ((r"^the[\s-]+", ""), (r"[\s_]+", "-"), (r"-?licen[cs]e$", ""), (r"^creativecommons\.org/licen[cs]es/", ""), (r"/$", "")):
        x = F.regexp_replace(x, pattern, by)
    return x


def escape_markup(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_xml(text: Column) -> Column:
    """For drawings: the five characters with a meaning in markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unrepresentable(text: Column) -> Column:
    """Holds the text a character that no page can carry? Only NUL is left, as strings are valid Unicode here."""
    return F.contains(text, F.char(F.lit(0)))


def presence_text(text: Column) -> Column:
    """White space collapsed and trimmed: the form in which outputs are searched."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), JS_SPACE, " "))


def needle(text: Column, most: int = 60, least: int = 20) -> Column:
    """The beginning of a text that a search for it uses: cut at the last blank beyond `least` characters, else hard."""
    whole = presence_text(text)
    cut = F.substring(whole, 1, most)
    at_blank = F.regexp_extract(cut, f"^([\\s\\S]{{{least + 1},}}) ", 1)
    return F.when(F.length(whole) <= most, whole).when(at_blank != "", at_blank).otherwise(cut)


def record_hash(raw: Column) -> Column:
    return F.sha2(F.regexp_replace(raw, r"\r?\n$", ""), 256)


def record_uid(slug: Column, line_no: Column, sha: Column) -> Column:
    return F.concat_ws(":", slug, F.concat(F.lit("L"), F.lpad(line_no.cast("string"), 6, "0")), F.substring(sha, 1, 12))


def sampling_key(seed: str, sha: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit("keyed-sha256-sort-v1"), F.lit(seed), sha), 256)


def format_rate(k: Column, n: Column, state: Column) -> Column:
    return F.when((state == "OK") & (n > 0), F.format_string("%d/%d (%.1f%%)", k, n, 100.0 * k / n)).otherwise(state)
