"""Raw ranges of counted characters against a walk from character to character."""

import random
import re

from readlake.operators import reading as P

WHITE = set("\t\n\x0b\x0c\r \xa0      　﻿")


def walk(sections):
    """What each counted character owns: marks wait for the next character, follow the last, or are nobody's."""
    out, raw = [], 0
    for text in sections:
        waiting, last, hang_on_next = None, None, True
        for c in text:
            if re.match("[0-9A-Za-zぁ-ゖァ-ヺ一-鿿]", c):
                out.append([raw if waiting is None else waiting, raw + 1])
                waiting, last, hang_on_next = None, out[-1], False
            else:
                hangs = c in P.HANGS
                if c in P.OPENS or hangs and hang_on_next:
                    waiting, last = raw if waiting is None else waiting, None
                else:
                    waiting = None
                    if c in P.TRAILS or hangs:
                        if last:
                            last[1] = raw + 1
                    else:
                        last = None
                if not hangs:
                    hang_on_next = c in P.OPENS or c in WHITE
            raw += 1
    return [tuple(x) for x in out]


def test_ranges_of_random_texts_and_nodes(spark):
    rnd = random.Random(7)
    letters = "aあ漢7" + "「『（([" + "」』。、！." + "…—〜" + "@★" + "".join(sorted(WHITE))
    nodes, want = [], {}
    for k in range(400):
        sections = []
        for n in range(rnd.randrange(1, 6)):
            text, boundary = "".join(rnd.choice(letters) for _ in range(rnd.randrange(8))), rnd.random() < 0.4
            nodes.append((k, n, boundary, text or None))
            if boundary or not sections:
                sections.append("")
            sections[-1] += text
        want[k] = walk(sections)
    frame = spark.createDataFrame(nodes, "id int, node int, boundary boolean, text string")
    got = {}
    for r in P.owned_ranges_of_nodes(frame).collect():
        got.setdefault(r.id, []).append((r.i, (r.start, r.end)))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([i for i, _ in sorted(v)] == [*range(len(v))] for v in got.values())


def test_indents_and_search_ranges(spark):
    texts = spark.createDataFrame([(1, "　……あ"), (2, "\xa0—あ"), (3, "「あ、い」う")], "id int, text string")
    assert sorted((r.id, r.i, r.start, r.end) for r in P.owned_ranges(texts).collect()) == [(1, 0, 1, 4), (2, 0, 1, 3), (3, 0, 0, 3), (3, 1, 3, 5), (3, 2, 5, 6)]
    hits = spark.createDataFrame([(3, "h", 0, 2), (3, "i", 2, 5), (3, "j", -1, 2)], "id int, hit string, at int, length int")
    assert [tuple(r) for r in P.search_raw_ranges(hits, texts).collect()] == [(3, "h", 1, 4)]
