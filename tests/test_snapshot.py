"""Page snapshots: what is kept is what a full scan reads, and unchanged files are not opened."""

import os
import random

import pytest

from marlstone.sources import wiki
from marlstone.sources.snapshot import Snapshot

WELCOME = "---\ntype: welcome\n---\n# Hello\n"


def put(folder, name, text, when):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.utime(path, (when, when))


def page(rng, name):
    return f"---\ntype: entity\ncreated: 2024-01-0{rng.randrange(1, 9)}\ntags: [a, t{rng.randrange(3)}]\n---\n# {name} é\nSee [[b{rng.randrange(9)}]].\n"


def refs(df):
    return sorted(map(str, df.select(*wiki.REF_COLUMNS).collect()))


@pytest.mark.parametrize("named", [1000, 0])
def test_refresh_reads_only_what_changed(spark, tmp_path, named):
    rng = random.Random(4)
    folder = str(tmp_path / "vault (1)")
    for i in range(6):
        put(folder, f"wiki/entities/p {i}.md", page(rng, f"p {i}"), 1_700_000_000 + i)
    put(folder, "wiki/welcome.md", WELCOME, 1_700_000_000)
    put(folder, "wiki/index.md", "- [[[[a]]]]", 1_700_000_000)
    put(folder, "notes/n.md", "[[[[kept]]]]", 1_700_000_000)
    put(folder, "notes/n.txt", "no page", 1_700_000_000)
    snap = Snapshot(spark, str(tmp_path / "kept"), folder, named_files=named, buckets=4)
    assert snap.refresh() == {"read": 9, "gone": 0, "mended": 0}
    scanned = lambda: refs(wiki.page_refs(wiki.scan(spark, folder), "wiki"))
    assert refs(snap.refs()) == scanned() and len(scanned()) == 6
    assert snap.refresh() == {"read": 0, "gone": 0, "mended": 0}

    # other letters under the same time and size: a snapshot that opened the file would have them
    path = os.path.join(folder, "wiki/entities/p 0.md")
    with open(path, encoding="utf-8", newline="") as f:
        before = f.read()
    put(folder, "wiki/entities/p 0.md", before.replace("See", "SEE"), 1_700_000_000)
    put(folder, "wiki/entities/p 1.md", page(rng, "newer") + "\n\n", 1_700_001_000)
    put(folder, "wiki/entities/p 2.md", page(rng, "restored") + "\n", 1_600_000_000)
    put(folder, "wiki/entities/q.md", page(rng, "old and new"), 1_600_000_000)
    os.remove(os.path.join(folder, "wiki/entities/p 3.md"))
    assert snap.refresh() == {"read": 3, "gone": 1, "mended": 0}
    held = {r.path: r.content for r in snap.held().collect()}
    assert held["wiki/entities/p 0.md"] == before and held["notes/n.md"] == "[[[[kept]]]]" and held["wiki/index.md"] == "- [[[[a]]]]"
    put(folder, "wiki/entities/p 0.md", before, 1_700_000_000)
    assert refs(snap.refs()) == scanned()
    assert snap.refresh()["read"] == 0


def test_pages_are_mended_once_when_read(spark, tmp_path):
    folder = str(tmp_path / "vault")
    bad = '---\ntype: entity\nsources: ["wiki/sources/a.md", "[[sources/b]]"]\nodd: x\n---\n# T\n[[[[c|d]]]] and [[[[e]]]]\n'
    put(folder, "wiki/entities/t.md", bad, 1_700_000_000)
    put(folder, "wiki/entities/u.md", "# U\n", 1_700_000_000)
    snap = Snapshot(spark, str(tmp_path / "kept"), folder, buckets=2)
    assert snap.refresh() == {"read": 2, "gone": 0, "mended": 1}
    fixes = {r.path: r.content for r in snap.fixes().collect()}
    assert fixes == {"wiki/entities/t.md": '---\ntype: entity\nsources:\n  - "[[sources/a]]"\n  - "[[sources/b]]"\nodd: x\n---\n# T\n[[c|d]] and [[e]]\n'}
    row = snap.held().where("path LIKE '%t.md'").first()
    assert (row.links_fixed, row.sources_fixed) == (2, 1)
    put(folder, "wiki/entities/t.md", fixes["wiki/entities/t.md"], 1_700_000_500)  # the host writes the text that was mended
    assert snap.refresh() == {"read": 1, "gone": 0, "mended": 0}
    assert snap.fixes().count() == 0


def test_empty_folders_and_bytes_that_are_no_text(spark, tmp_path):
    folder = str(tmp_path / "vault")
    os.makedirs(folder)
    snap = Snapshot(spark, str(tmp_path / "kept"), folder, buckets=2)
    assert snap.refresh() == {"read": 0, "gone": 0, "mended": 0}
    assert snap.refs().count() == 0 and snap.fixes().count() == 0
    put(folder, "wiki/a.md", "", 1_700_000_000)
    with open(os.path.join(folder, "wiki/b.md"), "wb") as f:
        f.write(b"\xff\xfe\x00bad")
    assert snap.refresh()["read"] == 1
    assert {r.path: r.title for r in snap.refs().collect()} == {"wiki/b.md": "b"}
