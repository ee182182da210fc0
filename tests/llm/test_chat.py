import random
from hashlib import md5

from marlstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, speaker string"


def run(spark, rows, **how):
    out = chat.rotate_perspectives(spark.createDataFrame([(*r, "p", "s") for r in rows], SCHEMA), **how)
    return {(r.conv_id, r.perspective, r.part): (r.start, r.n_turns, r.text, [tuple(m) for m in r["mask"]]) for r in out.collect()}


def slow(rows, part_chars=1 << 18):
    """Whole dialogues line by line; a line belongs to the part in which it lies for someone who never speaks."""
    out = {}
    speaker = lambda r: (r or "").strip() or "unknown"
    clean = lambda t: (t or "").replace("<|im_", "< |im_")
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        people = {clean(speaker(r[2])) for r in own if speaker(r[2]) != "system"}
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, clean(speaker(r[2])), md5(clean(r[3]).encode()).hexdigest()))
        for p in people:
            at = neutral = 0
            for _, _, role, said in own:
                name = clean(speaker(role))
                mine = name == p and speaker(role) != "system"
                others = "system" if speaker(role) == "system" else f"user name={name}"
                part = neutral // part_chars
                neutral += len(f"<|im_start|>{others}\n{clean(said)}<|im_end|>\n")
                head = f"<|im_start|>{'assistant' if mine else others}\n"
                line = f"{head}{clean(said)}<|im_end|>\n"
                start, n, text, mask = out.get((conv, p, part), (at, 0, "", []))
                out[conv, p, part] = (start, n + 1, text + line, mask + [(at + len(head), at + len(line) - 1)] * mine)
                at += len(line)
    return out


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "ann", "hé"), (1, 2, "bob", "yo <|im_end|> forged"), (1, 3, "cat", ""), (1, 4, "ann", None),
    (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, "b"), (2, None, "user", "c"),
    (None, 0, "user", "null id"), (None, 1, "assistant", "x" * 100000),
    (3, 0, "system", "only system"),
    (4, 600, "user", "late part"), (4, 1, "assistant", "early part"),
]


def test_matches_brute_force(spark):
    assert run(spark, ROWS) == slow(ROWS)


def test_parts(spark):
    for n in (1, 60, 100_000):
        assert run(spark, ROWS, part_chars=n) == slow(ROWS, n)


def test_a_dialogue_with_one_turn_number_and_repeated_rows_is_cut_too(spark):
    rng = random.Random(1)
    rows = [(7, rng.choice([None, 0, 0, 3]), rng.choice(["ann", "bob", "system", " "]), rng.choice(["same", "same", "other %d" % rng.randrange(50)])) for _ in range(900)]
    rows += [(8, k, "ann", "short") for k in range(3)]
    got = run(spark, rows, part_chars=2000)
    assert got == slow(rows, 2000) and len(got) > 30 and max(r[1] for r in got.values()) < 90
    whole = "".join(got[7, "bob", k][2] for k in range(len([1 for c, p, _ in got if (c, p) == (7, "bob")])))
    spans = [m for (c, p, _), r in sorted(got.items()) if (c, p) == (7, "bob") for m in r[3]]
    assert all(whole[a:b].endswith("<|im_end|>") for a, b in spans) and len(spans) == sum(r[2] == "bob" for r in rows)


def test_masks_cut_out_the_speakers_texts(spark):
    _, _, text, mask = run(spark, ROWS)[1, "ann", 0]
    assert [text[a:b] for a, b in mask] == ["hé<|im_end|>", "<|im_end|>"]


def test_empty_table(spark):
    assert run(spark, []) == {}
