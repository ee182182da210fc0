"""Edits of front matter in a page's text: the span of one key is found and replaced, every other character stays.

SQL functions only. The block is what lies before the first `\\n---` of a text that begins with `---`; a line ends at a line feed,
a carriage return or a Unicode line or paragraph separator, and a key counts at the beginning of a line only. Of repeated keys
the first is edited. A null text stays null, and a null value or list leaves the text as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_START = r"(?<![^\n\r\u2028\u2029])"
NO_BREAK = r"[^\n\r\u2028\u2029]"


def block_end(content: Column) -> Column:
    """How many characters come before the closing fence's line feed; null without a block."""
    end = F.locate("\n---", content, 4)
    return F.when(content.startswith("---") & (end > 0), end - 1)


def _span(block: Column, pattern: str) -> tuple[Column, Column]:
    """Where the first hit begins (0: none) and how many characters it has; regexp_instr would count UTF-16 units."""
    before = F.char_length(F.regexp_extract(block, f"(?s)^(.*?)(?:{pattern})", 1))
    return F.when(block.rlike(pattern), before + 1).otherwise(0), F.char_length(F.regexp_substr(block, F.lit(pattern)))


def _spliced(text: Column, at: Column, long: Column, new: Column) -> Column:
    return F.concat(F.left(text, at - 1), new, F.substring(text, at + long, F.length(text)))


def _edit(content: Column, pattern: str, new: Column, fresh: Column) -> Column:
    """The hit of the pattern in the block replaced by new; without a hit new is the block's last line; without a block, fresh."""
    end = block_end(content)
    block, rest = F.left(content, end), F.substring(content, end + 1, F.length(content))
    at, long = _span(block, pattern)
    edited = F.when(at > 0, _spliced(block, at, long, new)).otherwise(F.concat(block, F.lit("\n"), new))
    return F.when(new.isNull(), content).when(end.isNotNull(), F.concat(edited, rest)).otherwise(fresh)


def _list_pattern(key: str) -> str:
    return LINE_START + re.escape(key) + r":[^\n]*(?:\n[ \t]+[^\n]*)*"


def list_lines(key: str, items: Column) -> Column:
    """The lines of a list field; quotes inside items are escaped, null items left out."""
    lines = F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.concat(F.lit('  - "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit(f"{key}:\n"), F.array_join(lines, "\n"))


def set_field(content: Column, key: str, value: Column) -> Column:
    """`key: value` in place of the key's line, as a new last line, or as a new block before the text; the value is written as it is."""
    line = F.concat(F.lit(f"{key}: "), value)
    return _edit(content, LINE_START + re.escape(key) + ":" + NO_BREAK + "*", line, F.concat(F.lit("---\n"), line, F.lit("\n---\n\n"), content))


def set_list(content: Column, key: str, items: Column) -> Column:
    """A list field in place of the key's lines, inline or not, or as the block's last; a text without a block stays."""
    return _edit(content, _list_pattern(key), list_lines(key, items), content)


def replace_list(content: Column, key: str, items: Column) -> Column:
    """As set_list, but an empty list takes the key's lines away, and a text without a block gets one."""
    end = block_end(content)
    block, rest = F.left(content, end), F.substring(content, end + 1, F.length(content))
    at, long = _span(block, r"\n" + _list_pattern(key).removeprefix(LINE_START))
    without = F.when(end.isNotNull() & (at > 0), F.concat(_spliced(block, at, long, F.lit("")), rest)).otherwise(content)
    lines = list_lines(key, items)
    fresh = F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), content)
    some = F.exists(items, lambda x: x.isNotNull())
    return F.when(items.isNull(), content).when(some, _edit(content, _list_pattern(key), lines, fresh)).otherwise(without)


def add_to_list(content: Column, key: str, present: Column, new: Column) -> Column:
    """The list with the new items that are not among those present, each once; without any the text stays as it is.

    present is what the field holds now, as markup.front_matter reads it.
    """
    none = F.array().cast("array<string>")
    held = F.coalesce(present, none)
    every = F.array_union(held, F.filter(F.coalesce(new, none), lambda x: x.isNotNull()))
    return F.when(F.size(F.array_except(every, held)) > 0, replace_list(content, key, every)).otherwise(content)
