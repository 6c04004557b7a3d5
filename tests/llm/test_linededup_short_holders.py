"""Line dedup where the parts of a repeated passage stand singly in earlier documents."""

import random

from quernspark.llm import linededup

from test_operators import documents, plain_repeats


def test_short_holders_first(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    parts = [line(n) for n in (13, 14, 15, 13)]
    halves = [line(30), line(28)]
    rows = [(i, f"{line(8)}\n{x}\n{line(9)}") for i, x in enumerate(parts + halves)]
    rows += [(10 + i, "\n".join([line(6), *parts, line(7)])) for i in range(3)]
    rows += [(20, f"{line(5)} {parts[0]}"), (21, "\n".join([line(5), *parts]))]
    rows += [(30, "\n".join([line(4), *halves, line(4)])), (31, f"{line(3)}\n{halves[1]}"), (32, "\n".join([*halves, line(5)])), (None, line(70))]
    got = linededup.dedup_lines(documents(spark, [(i, t, None) for i, t in rows])).select("row.doc_id", "row.text", "removed").collect()
    gone = {(r.doc_id, r.text): {n for x in r.removed for n in range(x.lo, x.hi + 1)} for r in got}
    assert gone == plain_repeats(rows) | {(i, t): set() for i, t in rows if i == 31}
    assert sorted(len(x) for x in gone.values() if x) == [55, 55, 55, 58]
