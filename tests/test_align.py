"""Places of chunks against a plain search, and the time on long documents."""

import random
import time

from quarry.operators import align as AL


def plain(parts, text):
    out, cursor = [], 0
    for part in parts:
        found = None
        for begin in (cursor, 0):
            for n in AL.PROBES:
                p = (part or "")[:n].strip(" ")
                if found is None and len(p) >= AL.LEAST_PROBE and (at := text.find(p, begin)) >= 0:
                    found = at
        if found is not None:
            cursor = max(cursor, found + AL.STEP)
        out.append(found)
    return out


def test_against_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice(["aa", "b", "çé", "字", " ", "  ", "repeat this very line again and again "]) for _ in range(rng.randint(0, 200))]
        text = "".join(words)
        parts = []
        for _ in range(rng.randint(0, 20)):
            a = rng.randint(0, max(0, len(text) - 1))
            part = text[a : a + rng.choice([5, 24, 30, 90, 150, 260])]
            parts.append(rng.choice([part, part, part[: len(part) // 2] + "?" + part[len(part) // 2 :], " " + part, None, ""]))
        assert AL.find_all(parts, text) == plain(parts, text)


def test_hashes():
    import numpy as np

    text = "".join(chr(random.Random(1).randrange(32, 500) + k % 7) for k in range(400))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    for size in (1, 2, 3, 24, 48, 96, 192):
        h = AL.place_hashes(codes, size)
        assert len(h) == 401 - size and all(int(h[k]) == AL.text_hash(text[k : k + size]) for k in range(0, 401 - size, 13))


def test_long_documents():
    """A hundred thousand lines, found in order, all alike, or found nowhere."""
    distinct = [f"line {k} says {k * k} to whoever reads it" for k in range(100_000)]
    for parts, text in ((distinct, "\n".join(distinct)), ([f"{p}, never" for p in distinct], "\n".join(distinct)), (["the same header on every page"] * 100_000, "the same header on every page\n" * 100_000)):
        begin = time.time()
        found = AL.find_all(parts, text)
        assert time.time() - begin < 20 and len(found) == 100_000
    assert AL.find_all(distinct, "\n".join(distinct))[:2] == [0, len(distinct[0]) + 1]


def test_odd_rows(spark):
    long = "a sentence that is long enough to be found"
    rows = [(1, [long, None, "", "short"], f"x {long}"), (2, [long], None), (3, [], "t"), (4, None, "t"), (None, [long], long)]
    got = {r["doc"]: r["pos"] for r in AL.positions(spark.createDataFrame(rows, "doc long, parts array<string>, text string")).collect()}
    assert got == {1: [2, None, None, None], 2: [None], 3: [], 4: [], None: [0]}
