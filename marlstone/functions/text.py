"""Column expressions for text: segmentation, folding, names, hashes, estimates.

Everything here is built from Spark SQL functions and stays in the JVM.  Unicode
normal forms, which Spark has no function for, are in marlstone.functions.unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, and the scripts written without spaces.
WORD_CLASS = r"\p{L}\p{N}\p{M}"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
UNSPACED_RUN = rf"[{WORD_CLASS}&&[{UNSPACED}]]+"
SPACED_RUN = rf"[{WORD_CLASS}&&[^{UNSPACED}]]+"
CJK_RUN = r"[一-鿿぀-ゟ゠-ヿ가-힯ퟀ-퟿㐀-䶿]{2,}"
GRAM = 3
TURKISH_UPPER, TURKISH_LOWER = "İŞĞÜÖÇ", "işğüöç"
#: Common words that say nothing about a page's subject.
STOP_WORDS = (
    "also are been being both but can could did does each from had has have into its may might must not only other our shall should "
    "than that the their them then there these they this those through was were what when where which while will with would your"
).split()
CHARS_PER_TOKEN_CJK, CHARS_PER_TOKEN_OTHER = 1.25, 2.6
CJK_WIDE = r"[　-〿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿＀-￯]"


def _accent_table() -> tuple[str, str]:
    """Letters that decompose to one base letter and marks, and those base letters."""
    out = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and len(parts) > 1:
            out[chr(cp)] = base
    return "".join(out), "".join(out.values())


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[\\u0300-\\u036f]", "")


def windows(c: Column, n: int) -> Column:
    """All n-character windows of a string, in order."""
    last = F.char_length(c) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def segment(c: Column) -> Column:
    """Terms of a text: spaced words whole, unspaced scripts as character pairs (a lone character stays)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"{UNSPACED_RUN}|{SPACED_RUN}"), 0)
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{UNSPACED}]") & (F.char_length(r) > 1), windows(r, 2)).otherwise(F.array(r))))


def spaced_words(c: Column) -> Column:
    """segment for text without unspaced scripts, one regular expression only."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD_CLASS}]+"), 0)


def word_grams(term: Column) -> Column:
    """Distinct accent-free trigrams of a spaced word; none below three letters."""
    plain = strip_accents(term)
    return F.when(term.rlike(f"[{UNSPACED}]"), F.array().cast("array<string>")).otherwise(F.array_distinct(windows(plain, GRAM)))


_MARKS = dict(zip(map(ord, _ACCENTED), _PLAIN)) | dict.fromkeys(range(0x300, 0x370))


def plain_grams(word: str) -> list[str]:
    """word_grams of a spaced word, inside a task."""
    plain = word.translate(_MARKS)
    return list(dict.fromkeys(plain[i : i + GRAM] for i in range(len(plain) - GRAM + 1)))


def tokenize_query(c: Column) -> Column:
    """Query tokens in order: spaced runs of two or more, edge-trimmed pieces, CJK runs; each once."""
    low = F.lower(F.coalesce(c, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(rf"[{WORD_CLASS}&&[^{UNSPACED}]]{{2,}}"), 0)
    pieces = F.filter(F.transform(F.split(low, r"\s+"), lambda p: F.regexp_replace(p, rf"^[^{WORD_CLASS}]+|[^{WORD_CLASS}]+$", "")), lambda p: F.char_length(p) >= 2)
    return F.array_distinct(F.concat(runs, pieces, F.regexp_extract_all(low, F.lit(CJK_RUN), 0)))


def lexically_reliable(tokens: Column) -> Column:
    """At least two tokens of two characters, and at least half of all."""
    long = F.size(F.filter(tokens, lambda t: F.char_length(t) >= 2))
    return (long >= 2) & (long / F.greatest(F.size(tokens), F.lit(1)) >= 0.5)


def quoted(needle: Column) -> Column:
    return F.regexp_replace(needle, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def needle_hits(text_lower: Column, needle: Column) -> Column:
    """A spaced needle must begin at a word start (longer words count); any other needle is a plain substring."""
    bounded = needle.rlike(f"^{SPACED_RUN}$")
    at_start = F.regexp_like(text_lower, F.concat(F.lit(rf"(?<![{WORD_CLASS}])"), quoted(needle)))
    return F.when(bounded, at_start).otherwise(F.contains(text_lower, needle))


def cjk_pair_overlap(text_lower: Column, needle: Column) -> Column:
    """How many character pairs of a CJK needle of four or more characters occur in the text."""
    clause = needle.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{4,}$")
    return F.when(clause, F.size(F.filter(windows(needle, 2), lambda p: F.contains(text_lower, p)))).otherwise(0)


def turkish_fold(c: Column) -> Column:
    return F.lower(F.translate(c, TURKISH_UPPER, TURKISH_LOWER))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


def slug(c: Column, preserve_case: bool = False) -> Column:
    """File-name form: control characters and listed punctuation go, spaces and dots become single dashes.

    A blank text is `untitled`; one of nothing but punctuation is `untitled-` and a hash of it, the same every time.
    """
    text = trim_space(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", ""), r"[/\\:*?\"<>|,()'!、，。；：！？（）【】《》]", "")
    dashed = F.regexp_replace(F.regexp_replace(bare, r"[\s.]+", "-"), "-+", "-")
    out = trim_space(F.regexp_replace(dashed, "^-|-$", ""))
    out = out if preserve_case else F.lower(out)
    return F.when(text == "", "untitled").when(out == "", F.concat(F.lit("untitled-"), F.substring(F.sha2(text, 256), 1, 8))).otherwise(out)


def slug_keys(name: Column, aliases: Column, turkish: bool = False) -> Column:
    """Distinct slugs of a name and its aliases, blank ones left out."""
    names = F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda n: n.isNotNull() & (trim_space(n) != ""))
    return F.array_distinct(F.transform(names, lambda n: slug(turkish_fold(trim_space(n)) if turkish else n)))


def alias_key(c: Column) -> Column:
    return turkish_fold(trim_space(c))


def canonical_page_path(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(trim_space(c), r"\\", "/"), r"^(\./)+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(?i)\.md$", ""), "/$", ""))


def code_units(c: Column) -> Column:
    """The UTF-16 code units of a string."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    pair = lambda p: F.array(F.shiftright(p - 65536, 10) + 55296, (p - 65536) % 1024 + 56320)
    return F.flatten(F.transform(points, lambda p: F.when(p > 65535, pair(p)).otherwise(F.array(p))))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 code units."""
    step = lambda h, u: F.pmod((h.bitwiseXOR(u.cast("long"))) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(code_units(c), F.lit(2166136261).cast("long"), step)


def hex32(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def body_hash(c: Column) -> Column:
    """Length in hexadecimal and FNV-1a of the text with white space collapsed."""
    norm = F.regexp_replace(trim_space(c), r"\s+", " ")
    return F.concat(F.lower(F.hex(F.char_length(norm))), F.lit("-"), hex32(fnv1a(norm)))


def source_fingerprint(path: Column) -> Column:
    return F.substring(hex32(fnv1a(path)), 1, 6)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def source_slug(path: Column, max_length: int = 80) -> Column:
    """Slug of the file name, cut so that `_` and the path's fingerprint fit."""
    return F.concat(F.left(slug(base_name(path)), F.lit(max_length - 7)), F.lit("_"), source_fingerprint(path))


def normalize_for_match(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]", "")


def bigram_set(c: Column) -> Column:
    return F.array_distinct(windows(normalize_for_match(c), 2))


def body_word_set(c: Column) -> Column:
    """Distinct lower-case words of more than three characters, stop words left out."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s一-鿿]", " "), r"\s+")
    return F.array_except(F.filter(words, lambda w: F.char_length(w) > 3), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when either set is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def normalize_quote(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def normalize_statement(c: Column) -> Column:
    """Quote form after links became their text and markup and footnote marks went."""
    shown = F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1")
    shown = F.regexp_replace(F.regexp_replace(shown, r"\[\^[^\]]*\]", ""), r"[*_`~>#]", "")
    return normalize_quote(shown)


def link_reduced(c: Column) -> Column:
    """Each link becomes its display text, else its target's last name with the heading."""
    shown = F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1")
    return F.regexp_replace(shown, r"\[\[(?:[^\]|]*/)?([^\]|/]+)\]\]", "$1")


def estimate_tokens(c: Column) -> Column:
    wide = F.regexp_count(c, F.lit(CJK_WIDE))
    return F.ceil(wide / F.lit(CHARS_PER_TOKEN_CJK) + (F.char_length(c) - wide) / F.lit(CHARS_PER_TOKEN_OTHER))


def context_keywords(c: Column, least: int = 5) -> Column:
    """Distinct lower-case words of so many characters of the whole text."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}-]+")
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= least))


def context_around(text: Column, needles: Column, radius: int) -> Column:
    """Text around the first needle that occurs, else the beginning."""
    found = F.element_at(F.filter(needles, lambda n: (n != "") & F.contains(text, n)), 1)
    position = F.position(found, text)
    around = F.substring(text, F.greatest(position - radius, F.lit(1)), F.least(position - 1, F.lit(radius)) + F.char_length(found) + radius)
    return F.when(F.size(F.filter(needles, lambda n: (n != "") & F.contains(text, n))) > 0, around).otherwise(F.left(text, F.lit(2 * radius)))


def name_variants(name: Column) -> Column:
    """A name, and the outer and inner parts of a trailing parenthesis."""
    outer = F.trim(F.regexp_extract(name, r"^(.*?)\s*[(（]([^()（）]+)[)）]\s*$", 1))
    inner = F.trim(F.regexp_extract(name, r"^(.*?)\s*[(（]([^()（）]+)[)）]\s*$", 2))
    return F.filter(F.array_distinct(F.array(name, outer, inner)), lambda n: n != "")


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def date_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def fold_key(c: Column) -> Column:
    """Case- and accent-free comparison key of a vocabulary value."""
    return strip_accents(F.lower(F.trim(c)))


def vocabulary_csv(c: Column) -> Column:
    """A comma list trimmed, blanks dropped, later repeats (whatever case) dropped."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(F.transform(items, lambda y: F.lower(y)), F.lower(s["x"])) == s["i"] + 1)
    return F.array_join(F.transform(kept, lambda s: s["x"]), ", ")


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
