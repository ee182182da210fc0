"""Edits of front matter against a line-by-line editor, on random pages."""

import random

from pyspark.sql import functions as F

from marlstone.functions import frontedit, markup

KEYS = ["tags", "type", "odd.key", "aliases"]


def random_page(rng):
    if rng.random() < 0.2:
        return rng.choice(["", "plain\ntags: no block", "---\ntags: open", "--- \n"])
    lines = []
    for key in rng.sample([*KEYS, "tagsX", "other"], rng.randrange(5)):
        form = rng.randrange(4)
        if form == 0:
            lines += [f"{key}:", *[f"{rng.choice(['  ', ' ', chr(9)])}- \"v{i}$1\"" for i in range(rng.randrange(3))]]
        else:
            lines.append(f"{key}: " + rng.choice(["[a, 'b']", "x # é😀", "", "tags: inner"]))
    lines += [rng.choice(["", "  stray: tags: z"])] * rng.randrange(2)
    return "\n".join(["---", *lines, "---", rng.choice(["", "\nBody tags: q\n\ntags: late\n---\n", "body  \n"])])


def edited(content, key, new, whole):
    """The plain editor: lines of the block, walked one by one; new None takes the key away."""
    end = content.find("\n---", 3) if content.startswith("---") else -1
    if end < 0:
        return None
    lines, rest, out, at, done = content[:end].split("\n"), content[end:], [], 0, False
    while at < len(lines):
        line, at = lines[at], at + 1
        if not done and line.startswith(key + ":"):
            while whole and at < len(lines) and lines[at][:1] in (" ", "\t") and lines[at]:
                at += 1
            done = True
            out += [new] if new is not None else []
        else:
            out.append(line)
    return "\n".join(out + ([new] if not done and new is not None else [])) + rest


def test_edits_keep_every_other_character(spark):
    rng = random.Random(11)
    rows = [(i, random_page(rng), rng.choice(["", "v $1 \\n", "é😀"]), [rng.choice(['a "q"', "b$2", "ö"]) for _ in range(rng.randrange(3))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, content string, value string, items array<string>")
    listed = lambda key, items: f"{key}:\n" + "\n".join('  - "' + x.replace('"', '\\"') + '"' for x in items)
    for key in KEYS:
        c = F.col("content")
        got = df.select("id", frontedit.set_field(c, key, F.col("value")), frontedit.set_list(c, key, F.col("items")), frontedit.replace_list(c, key, F.col("items"))).collect()
        for (_, content, value, items), (_, one, several, replaced) in zip(rows, sorted(got)):
            line = f"{key}: {value}"
            want = edited(content, key, line, False)
            assert one == (f"---\n{line}\n---\n\n{content}" if want is None else want)
            want = edited(content, key, listed(key, items), True)
            assert several == (content if want is None else want)
            want = edited(content, key, listed(key, items) if items else None, True)
            assert replaced == (want if want is not None else content if not items else f"---\n{listed(key, items)}\n---\n\n{content}")


def test_added_items_are_read_back_and_a_second_time_changes_nothing(spark):
    df = spark.createDataFrame(
        [("---\ntags: [a, b]\nx: 1\n---\nbody", ["b", "c", "c"]), ("---\ntags:\n  - a\n---\n", ["a"]), ("---\nx: 1\n---\n", ["a"]), ("no block", ["a"]), ("no block", []), (None, ["a"]), ("---\ntags: a\n---", None)],
        "content string, new array<string>",
    )
    add = lambda d: d.withColumn("content", frontedit.add_to_list(F.col("content"), "tags", F.col("tags"), F.col("new")))
    read = lambda d: d.withColumn("tags", markup.front_matter("content")["tags"])
    once = read(add(read(df)))
    again = add(once)
    assert [r.content for r in once.collect()] == [r.content for r in again.collect()]
    assert [r.tags for r in once.collect()] == [["a", "b", "c"], ["a"], ["a"], ["a"], None, None, ["a"]]
    assert once.first().content == '---\ntags:\n  - "a"\n  - "b"\n  - "c"\nx: 1\n---\nbody'


def test_null_values_and_line_ends(spark):
    df = spark.createDataFrame([("---\r\ntype: a\r\nb: c\r\n---\r\n", "x"), ("---\ntype: a\n---", None), (None, "x")], "content string, value string")
    got = [r[0] for r in df.select(frontedit.set_field(F.col("content"), "type", F.col("value"))).collect()]
    assert got == ["---\r\ntype: x\r\nb: c\r\n---\r\n", "---\ntype: a\n---", None]
