"""Templates of crowded leaves against one-by-one assignment."""

import random

from ledgersift.llm import line_dedup

DOCS = "doc_id long, text string"


def test_a_leaf_has_any_number_of_templates(spark):
    """Two frequent ordinary lines and three families with a variable word, all in one leaf."""
    names = "anna bert carla dora emil franz gerda hugo".split()
    tails = ["one the quick brown fox jumps over lazy dogs at noon {} end", "two a slow green snail walks under tall trees by night {} end", "six some large white birds sing near cold lakes each spring {} end"]
    plain = ["all of it was written by hand in old books with red ink", "many of them went home on foot after a day of hard work"]
    rows = []
    for i, n in enumerate(names):
        rows += [(100 * k + i, "this text was here " + t.format(n)) for k, t in enumerate(tails, 1)]
    rows += [(1000 + 20 * k + i, "this text was here " + t) for k, t in enumerate(plain) for i in range(12)]
    width = {len(t.split()) for _, t in rows}
    assert len(width) == 1, width
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    first = {100, 200, 300, 1000, 1020}
    assert {d for d, t in got.items() if t} == first


def test_templates_equal_one_by_one_assignment(spark):
    rng = random.Random(3)
    bases = [[rng.randrange(3) for _ in range(line_dedup.BANDS)] for _ in range(12)]
    lines = []
    for d in range(400):
        bands = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            bands[rng.randrange(line_dedup.BANDS)] = rng.randrange(3)
        lines.append((d, d, 0, 16, rng.randrange(3), *bands))
    schema = "doc_id long, text_hash long, line_no int, n int, leaf long, " + ", ".join(f"{b} int" for b in line_dedup.B)
    table = spark.createDataFrame(lines, schema)
    got = {tuple(r[c] for c in ("leaf", *line_dedup.B)): r["template"] for r in line_dedup._templates(table).collect()}
    held = {}
    for d, _, _, _, *line in lines:
        held.setdefault(tuple(line), []).append(d)
    leaders, wanted = [], {}
    for line in sorted(held, key=lambda x: (-len(held[x]), held[x][0])):
        agree = (x for x in leaders if x[0] == line[0] and sum(a == b for a, b in zip(x[1:], line[1:])) >= 6)
        wanted[line] = next(agree, line)
        if wanted[line] == line:
            leaders.append(line)
    assert max(sum(x[0] == leaf for x in leaders) for leaf in range(3)) > 2
    assert {x: got[x] for x in held} == {x: got[wanted[x]] for x in held}
    assert len(set(got.values())) == len(leaders)
