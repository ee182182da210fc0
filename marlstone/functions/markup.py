"""Front matter, sections, links, mentions, logs, replies and diffs of wiki pages.

Row-local parsers.  Those that need more than regular expressions run as Arrow-batched
pandas UDFs; the plain functions behind them are the unit that is tested.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.udf import arrow_udf

FRONT = re.compile(r"^---\n(.*?)\n---", re.S)
LIST_KEYS = ("aliases", "sources", "tags")
KNOWN_KEYS = ("type", "created", "updated", "reviewed", *LIST_KEYS)
FRONT_TYPE = "struct<type:string,created:string,updated:string,reviewed:boolean,aliases:array<string>,sources:array<string>,tags:array<string>,extra:map<string,string>>"
LINK = re.compile(r"\[\[([^\]|#]+?)(?:#\^?[^\]|]+)?(?:\|([^\]]+))?\]\]")
ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _bare(value: str) -> str:
    value = value[1:] if value[:1] in "\"'" and value else value
    return value[:-1] if value[-1:] in ("'", '"') else value


def parse_front(content: str | None) -> dict | None:
    """The leading block as a mapping: lists for the list keys (a scalar is wrapped, blanks dropped), text otherwise; None without one."""
    found = FRONT.match(content or "")
    if not found:
        return None
    out: dict = {}
    lines = found[1].split("\n")
    at = 0
    while at < len(lines):
        key, colon, value = lines[at].partition(":")
        key, value = key.strip(), value.strip()
        at += 1
        if not colon or lines[at - 1].strip().startswith("- "):
            continue
        items = []
        while at < len(lines) and lines[at].strip().startswith("- "):
            items.append(_bare(lines[at].strip()[2:].strip()))
            at += 1
        if items:
            out[key] = items
        elif key == "reviewed":
            out[key] = value == "true"
        elif key in ("type", "created", "updated"):
            out[key] = value
        elif value.startswith("[") and value.endswith("]"):
            out[key] = [x for x in (_bare(v.strip()) for v in value[1:-1].split(",")) if x]
        else:
            out[key] = _bare(value)
    for key in LIST_KEYS:
        value = out.get(key)
        if isinstance(value, str):
            out[key] = [value] if value.strip() else []
        elif isinstance(value, list):
            out[key] = [v for v in value if v.strip()]
        else:
            out.pop(key, None)
    return out


def _front_row(content: str | None) -> dict | None:
    fm = parse_front(content)
    if fm is None:
        return None
    extra = {k: ", ".join(v) if isinstance(v, list) else str(v) for k, v in fm.items() if k not in KNOWN_KEYS}
    return {k: fm.get(k) for k in KNOWN_KEYS} | {"extra": extra}


@arrow_udf(FRONT_TYPE)
def front_matter(content: pd.Series) -> pd.DataFrame:
    rows = [_front_row(c) or dict.fromkeys((*KNOWN_KEYS, "extra")) for c in content]
    return pd.DataFrame(rows, columns=["type", "created", "updated", "reviewed", "aliases", "sources", "tags", "extra"])


def body(content: Column) -> Column:
    """The text after the closing fence, trimmed; the whole text without a block."""
    end = F.locate("\n---", content, 4)
    after = F.regexp_replace(F.substring(content, end + 4, F.length(content)), r"^\s+|\s+$", "")
    return F.when(content.startswith("---") & (end > 0), after).otherwise(content)


def is_blank(content: Column) -> Column:
    return F.regexp_replace(body(content), r"\s", "") == ""


def origin_notes(source_file: Column, sources: Column) -> Column:
    """source_file and sources in order, link brackets off, blanks dropped."""
    both = F.concat(F.when(source_file.isNotNull(), F.array(source_file)).otherwise(F.array().cast("array<string>")), F.coalesce(sources, F.array().cast("array<string>")))
    bare = F.transform(both, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^\[\[(.*)\]\]$", "$1")))
    return F.filter(bare, lambda s: s != "")


def belongs_to(front: Column, origins: Column, note: Column) -> Column:
    """A page without front matter or origins belongs to any note."""
    return front.isNull() | (F.size(origins) <= 0) | F.array_contains(origins, note)


def repaired_opening(content: Column) -> Column:
    """An opening of two or more dashes becomes three, if a key follows it."""
    text = F.regexp_replace(content, r"^\s+", "")
    return F.when(text.rlike(r"^-{2,}[ \t]*\r?\n[A-Za-z_][\w.-]*\s*:"), F.regexp_replace(text, r"^-{2,}[ \t]*", "---")).otherwise(content)


def render_front(fm: dict, passed: Sequence[str] = (), empty_tags: bool = False) -> str:
    """A block in the canonical key order; unknown lines are passed on after the dates."""
    out = ["---"] + [f"{k}: {fm[k]}" for k in ("type", "created", "updated") if fm.get(k)] + list(passed)
    listed = lambda k, v: [f"{k}:"] + [f'  - "{x}"' for x in v]
    out += listed("sources", fm["sources"]) if fm.get("sources") else []
    out += listed("tags", fm["tags"]) if fm.get("tags") else ["tags:"] if empty_tags else []
    out += ["reviewed: true"] if fm.get("reviewed") else []
    aliases = list(dict.fromkeys(a for a in fm.get("aliases") or [] if a))
    return "\n".join(out + (listed("aliases", aliases) if aliases else []) + ["---"])


def passed_lines(content: str) -> list[str]:
    """The raw lines of keys that are not known, with what is indented below them."""
    found = FRONT.match(content)
    out, taking = [], False
    for line in found[1].split("\n") if found else []:
        if not line:
            continue
        if line[0] not in " \t":
            key = re.match(r"([A-Za-z_][\w-]*)\s*:", line)
            taking = bool(key) and key[1] not in KNOWN_KEYS
        if taking:
            out.append(line)
    return out


def merged_list(existing: Column, new: Column) -> Column:
    """Existing entries, then new ones not among them."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(existing, none), F.coalesce(new, none))


def folded_union(existing: Column, new: Column) -> Column:
    """As merged_list, entries being equal whatever their case; the first spelling stays."""
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(existing, none), F.coalesce(new, none))
    low = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.filter(every, lambda x, i: (F.trim(x) != "") & (F.array_position(low, F.lower(F.trim(x))) == i + 1))


# links and sections


def links(line: Column) -> Column:
    """array<struct<path, alias>> of a line's links, trimmed."""
    paths = F.transform(F.regexp_extract_all(line, F.lit(LINK.pattern), 1), lambda p: F.trim(p))
    aliases = F.transform(F.regexp_extract_all(line, F.lit(LINK.pattern), 2), lambda a: F.nullif(F.trim(a), F.lit("")))
    return F.zip_with(paths, aliases, lambda p, a: F.struct(p.alias("path"), a.alias("alias")))


def section(text: Column, label: str) -> Column:
    """The body of the first H2 section of a label, null without one."""
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)##\s+{re.escape(label)}[ \t]*\n(.*?)(?=\n##\s|\z)", 1)
    has = text.rlike(rf"(?i)(?:^|\n)##\s+{re.escape(label)}[ \t]*(\n|\z)")
    return F.when(has, found)


def without_section(text: Column, label: str) -> Column:
    return F.regexp_replace(text, rf"(?is)(?:^|\n)##\s+{re.escape(label)}[ \t]*\n.*?(?=\n##\s|\z)", "")


MENTION = re.compile(r'^[-*]\s+"([^"]+)"(?:\s*\(([^)]*)\))?(?:\s*[—-]\s*\[\[([^\]|]+)(?:\|[^\]]*)?\]\])?\s*$', re.M)
MENTIONS_TYPE = "array<struct<quote:string,translation:string,source_path:string>>"


@arrow_udf(MENTIONS_TYPE)
def mentions(block: pd.Series) -> pd.Series:
    """Quote bullets of a mentions section, with translation and source where given."""
    return block.map(lambda b: [{"quote": q.strip(), "translation": t or None, "source_path": p.strip() or None} for q, t, p in MENTION.findall(b or "")])


def merge_mentions(old: Column, new: Column) -> Column:
    """old, then those of new whose quote and source are not among them."""
    key = lambda m: F.concat_ws("\0", m["quote"], F.coalesce(m["source_path"], F.lit("")))
    every = F.concat(old, new)
    keys = F.transform(every, key)
    return F.filter(every, lambda m, i: F.array_position(keys, key(m)) == i + 1)


def snap_header(header: Column, labels: Sequence[str], most: int = 3) -> Column:
    """The label equal to a header, else the only nearest within so many edits, else null."""
    near = F.array(*[F.struct(F.levenshtein(F.trim(header), F.lit(x)).alias("d"), F.lit(x).alias("label")) for x in labels])
    best = F.array_min(near)
    rivals = F.size(F.filter(near, lambda n: n["d"] == best["d"]))
    return F.when(F.trim(header).isin(*labels), F.trim(header)).when((best["d"] <= most) & (rivals == 1), best["label"])


def summary_of(text: str, labels: Sequence[str], most: int) -> str:
    """The first labelled section with links as their text, cut at the last sentence end within `most` characters, else with an ellipsis."""
    for label in labels:
        found = re.search(rf"(?:^|\n)##\s+{re.escape(label)}[ \t]*\n(.*?)(?=\n#{{1,3}}\s|\Z)", text, re.S)
        if found and found[1].strip():
            shown = LINK.sub(lambda m: m[2] or m[1].split("/")[-1], found[1]).strip()
            if len(shown) <= most:
                return shown
            cut = max(shown.rfind(e, 0, most) for e in (".", "!", "?", "。", "！", "？"))
            return shown[: cut + 1] if cut > 0 else shown[: most - 1] + "…"
    return ""


# logs


#: Fixed values of the log format: the forms in which a summary names a counter, the first that is found counting.
KPI_PATTERNS = {
    "total_pages": (r"共\s*(\d+)\s*个页面", r"(?i)(\d+)\s*pages?\b"),
    "missing_aliases": (r"(\d+)\s*个缺失别名", r"(?i)(\d+)\s*missing\s*alias(?:es)?", r"缺失别名\s*(\d+)"),
    "duplicates": (r"重复\s*(\d+)", r"(?i)(\d+)\s*duplicates?"),
    "dead_links": (r"断链\s*(\d+)", r"(?i)(\d+)\s*dead\s*links?"),
    "orphans": (r"孤立\s*(\d+)", r"(?i)(\d+)\s*orphans?"),
    "empty_pages": (r"空洞\s*(\d+)", r"(?i)(\d+)\s*empty\s*(?:pages?|stubs?)"),
    "unsourced": (r"无来源引证\s*(\d+)", r"(?i)(\d+)\s*unsourced"),
    "tag_violations": (r"标签越界\s*(\d+)", r"(?i)(\d+)\s*tag\s*violations?"),
    "seconds": (r"耗时\s*(\d+)\s*秒", r"(?i)(\d+)\s*seconds?", r"(?i)(\d+)\s*s\s"),
}


def kpis(line: Column) -> Column:
    """The counters of a maintenance summary; null where a counter is not named."""
    found = lambda forms: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in forms])
    return F.struct(*[found(forms).cast("int").alias(k) for k, forms in KPI_PATTERNS.items()])


def operation_kind(title: Column, quoted_pages: Column) -> Column:
    """Kind of a log entry by its heading; quoted_pages says whether a quoted line counts pages."""
    low = F.lower(title)
    return (
        F.when(low.rlike("维护|maintenance|wartung|mantenimiento|manutenção|manutenzione"), "maintenance")
        .when(low.startswith("ingest") | F.contains(low, F.lit("ingest |")), "ingest")
        .when(low.rlike("lint|alias|fix"), "fix").when(quoted_pages, "maintenance").otherwise("other")
    )


def log_entries(lines):
    """(entry, date, time, operation, title, kind, body) of log lines (pos, line): an entry runs from its H2 to the next."""
    from marlstone.operators.running import running_sum

    head = r"^## \[([0-9]{4}-[0-9]{2}-[0-9]{2})(?: ([0-9]{2}:[0-9]{2}))?\] (.+)$"
    numbered = running_sum(lines, F.col("line").rlike(head).cast("int"), "entry", "pos").where("entry > 0")
    rows = numbered.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    first = F.get(F.col("rows"), F.lit(0))["line"]
    rest = F.regexp_extract(first, head, 3)
    told = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: r["line"])
    counted = F.exists(told, lambda x: x.rlike(r"(?i)^>.*\d+\s*(个|page)"))
    operation = F.trim(F.regexp_extract(rest, r"^([^|]*)", 1))
    return rows.select(
        "entry", F.to_date(F.regexp_extract(first, head, 1)).alias("date"), F.nullif(F.regexp_extract(first, head, 2), F.lit("")).alias("time"), operation.alias("operation"),
        F.when(F.contains(rest, F.lit("|")), F.trim(F.regexp_extract(rest, r"^[^|]*\|(.*)$", 1))).alias("title"), operation_kind(operation, counted).alias("kind"), told.alias("body"),
    )


def ingest_metrics(tail: Column) -> Column:
    """struct<seconds, bytes, model> of a suffix such as `12m30s · 4.2 KB · model`."""
    parts = F.filter(F.transform(F.split(tail, r"\s·\s"), lambda p: F.trim(p)), lambda p: p != "")
    timed = lambda p: p.rlike(r"(?i)^(\d+(\.\d+)?m)?(\d+(\.\d+)?s)?$")
    sized = lambda p: p.rlike(r"(?i)^\d+(\.\d+)?\s*(B|KB|MB|GB)$")
    number = lambda p, unit: F.coalesce(F.nullif(F.regexp_extract(p, rf"(?i)(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = F.aggregate(F.filter(parts, timed), F.lit(0.0), lambda s, p: s + F.round(number(p, "m") * 60 + number(p, "s")))
    one = F.try_element_at(F.filter(parts, sized), F.lit(-1))
    power = F.when(one.rlike("(?i)GB$"), 3).when(one.rlike("(?i)MB$"), 2).when(one.rlike("(?i)KB$"), 1).otherwise(0)
    size = F.round(F.regexp_extract(one, r"^(\d+(?:\.\d+)?)", 1).cast("double") * F.pow(F.lit(1024.0), power)).cast("long")
    model = F.try_element_at(F.filter(parts, lambda p: ~timed(p) & ~sized(p)), F.lit(-1))
    return F.struct(F.when(F.size(F.filter(parts, timed)) > 0, seconds.cast("long")).alias("seconds"), size.alias("bytes"), model.alias("model"))


# replies and texts


def strip_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")


def reasoning(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<think(?:ing)?>(.*?)</think(?:ing)?>"), 1)


def cleaned_reply(text: Column) -> Column:
    """Reasoning, an outer fence and what precedes the first heading are dropped, and space at both ends."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    inner = F.regexp_replace(trimmed(strip_reasoning(text)), r"(?s)\A```[A-Za-z]*\n(.*)\n```\z", "$1")
    return trimmed(F.when(inner.rlike(r"(?m)^#{1,6}\s") & ~inner.startswith("---"), F.regexp_replace(inner, r"(?sm)\A.*?(?=^#{1,6}\s)", "")).otherwise(inner))


def salvage_json(text: str | None) -> tuple[str, dict | None]:
    """(outcome, object): the JSON object in a reply, after fences and reasoning went and open brackets were closed."""
    bare = re.sub(r"<think(?:ing)?>.*?</think(?:ing)?>", "", text or "", flags=re.S | re.I).strip()
    bare = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", bare)
    start = bare.find("{")
    if not bare:
        return "empty", None
    if start < 0:
        return "malformed", None
    decoder = json.JSONDecoder()
    tried = [bare[start:]]
    stack, quoted, escaped = [], False, False
    for c in bare[start:]:
        if quoted:
            quoted, escaped = (not (c == '"' and not escaped)), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    tried.append(re.sub(r",\s*$", "", bare[start:]) + ('"' if quoted else "") + "".join(reversed(stack)))
    tried.append(re.sub(r",(\s*[}\]])", r"\1", tried[-1]))
    for k, t in enumerate(tried):
        try:
            value, _ = decoder.raw_decode(t)
        except ValueError:
            continue
        return ("ok" if k == 0 else "repaired"), value
    return "malformed", None


@arrow_udf("struct<outcome:string,json:string>")
def salvaged(text: pd.Series) -> pd.DataFrame:
    rows = [salvage_json(t) for t in text]
    return pd.DataFrame([(o, None if v is None else json.dumps(v, ensure_ascii=False)) for o, v in rows], columns=["outcome", "json"])


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """(op, line) from old to new by a longest common subsequence; an addition comes before a removal of equal merit."""
    a, b = old.split("\n"), new.split("\n")
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("eq", a[i]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or best[i][j + 1] > best[i + 1][j]):
            out.append(("add", b[j]))
            j += 1
        else:
            out.append(("del", a[i]))
            i += 1
    return out


@arrow_udf("array<struct<op:string,line:string>>")
def diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "line": x} for o, x in line_diff(a or "", b or "")] for a, b in zip(old, new)])


LOOP = re.compile(r"(.{3,120}?)\1{3,}", re.S)


def repetition_loop(text: str | None, least: int = 200) -> dict | None:
    """The longest run of a unit of 3 to 120 characters four or more times in a row, if it has `least` characters and a letter or digit."""
    best = None
    for m in LOOP.finditer(text or ""):
        if len(m[0]) >= least and any(c.isalnum() for c in m[1]) and (best is None or len(m[0]) > best["chars"]):
            best = {"unit": m[1], "repeats": len(m[0]) // len(m[1]), "chars": len(m[0])}
    return best


@arrow_udf("struct<unit:string,repeats:int,chars:int>")
def repetition(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repetition_loop(t) or {"unit": None, "repeats": None, "chars": None} for t in text], columns=["unit", "repeats", "chars"])


def source_borne(unit: Column, source: Column) -> Column:
    """A loop that the source itself has is no fault of the text."""
    return F.contains(source, F.repeat(unit, F.lit(4)))


def heading_spacing(text: str) -> str:
    """A blank line after each heading and no runs of blank lines, fences untouched."""
    out: list[str] = []
    fenced = False
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        if not fenced and not line.strip() and out and not out[-1].strip():
            continue
        if out and not fenced and re.match(r"#{1,6}\s", out[-1]) and line.strip():
            out.append("")
        out.append(line)
    return "\n".join(out)


def each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as a column function, in Arrow batches."""
    @arrow_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else f(t))

    return run


def numbered_citations(answer: str) -> tuple[str, list[str]]:
    """An answer whose links carry numbers by first appearance of their page, and those pages."""
    order: dict[str, int] = {}

    def mark(m: re.Match) -> str:
        n = order.setdefault(m[1].strip(), len(order) + 1)
        return f"{m[0]}[{n}]"

    return LINK.sub(mark, answer), list(order)


def fill(template: Column, values: Column) -> Column:
    """{{key}} replaced from a map; unknown keys stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def index_lines(lines):
    """(path, title, aliases, source_slug, summary) of index bullets (line); other lines are dropped."""
    bullet = r"^- \[\[([^\]|]+)(?:\|[^\]]+)?\]\]\s*(?:`aliases:\s*([^`]+)`)?\s*(?:`source:\s*([^`]+)`)?(?:\s*-\s*(.+))?$"
    part = lambda k: F.regexp_extract("line", bullet, k)
    aliases = F.filter(F.transform(F.split(part(2), ","), lambda a: F.trim(a)), lambda a: a != "")
    return lines.where(F.col("line").rlike(bullet)).select(
        part(1).alias("path"), F.element_at(F.split(part(1), "/"), -1).alias("title"), aliases.alias("aliases"), F.nullif(F.trim(part(3)), F.lit("")).alias("source_slug"), F.trim(part(4)).alias("summary")
    )


@arrow_udf("string")
def summaries(text: pd.Series, labels: pd.Series, most: pd.Series) -> pd.Series:
    """summary_of for columns."""
    return pd.Series([summary_of(t or "", list(x), int(m)) for t, x, m in zip(text, labels, most)])
