"""Vector codes, phrases and language-model scores against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import codes, context_tree, phrases
from quarry.llm import queries as Q

VECTORS = "vec_id long, embedding array<float>, label int, code string, x int"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_phrases"])
def test_oracle(name, same):
    same(Q.QUERIES[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("n,width,spread", [(1, 3, 5), (2, 1, 2), (16, 2, 2), (16, 8, 4000), (13, 4, 1)])
def test_vantage_tree(n, width, spread):
    rng = np.random.default_rng(n * 100 + width)
    entries, asked = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (3000, width))
    square = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    which, best = codes.VantageTree(entries).nearest(asked)
    assert (which == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()  # argmin takes the lowest index


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in seeds] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((square(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sums = Counter()
    for _, _, error, label in out:
        sums[label] += error
    return sorted(((i, code, error, sums[label]) for i, code, error, label in out), key=repr), codes.fingerprint(np.array(books, np.int64))


def test_vector_codes_odd(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(16)], k % 3, "c", k) for k in range(60)]
    rows += [(3, rows[5][1], None, "c", 0), (3, rows[5][1], None, "c", 0), (None, rows[6][1], 7, None, None), (70, None, 1, "c", 1), (71, [1.0] * 15 + [None], 1, "c", 1)]
    rows += [(72, [float("nan")] + [0.0] * 15, 1, "c", 1), (73, [float("inf")] + [0.0] * 15, 1, "c", 1), (74, [0.5] * 3, 1, "c", 1), (75, [], 2, "c", 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    seen = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None, r["label"]) for r in table.collect()]
    want, digest = plain_codes(seen)
    got = codes.compress(table).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert codes.compress(table.limit(0)).collect() == []
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1, "c", 1)], VECTORS)).collect()


def test_codes_decode(spark):
    table = codes.quantize(spark.createDataFrame([(k, [k / 10] * 8, 0, "c", 0) for k in range(5)], VECTORS))
    book = codes.train(table)
    back = codes.decode(codes.encode(table, book), book).orderBy("id").collect()
    assert [r["x"][0] for r in back] == [math.floor(4096 * float(np.float32(k / 10))) for k in range(5)]  # as many entries as rows: nothing is lost


def plain_phrases(rows, least=10, share=50, top=2000, most_words=3):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        piece = [[]]
        word = ""
        for c in (text or "").translate(table) + " ":
            if c in " \t" or c in ".,;:!?\n\x0b\x0c\r":
                if word:
                    piece[-1].append(word)
                word = ""
                if c not in " \t":
                    piece.append([])
            else:
                word += c
        for p in piece:
            n[lang] += len(p)
            for s in range(1, most_words + 1):
                for i in range(len(p) - s + 1):
                    f[lang, tuple(p[i : i + s])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                longer[lang, p[i : i + s]] = max(longer[lang, p[i : i + s]], a)
    out = {}
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, k, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in out.items() for k, (score, a, p, left, right) in enumerate(sorted(all_)[:top], 1)]


def phrase_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "B", "ö", "the", "of", "x.y"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(n))
    return [("en", text(400)), ("en", text(300)), ("de", text(300)), (None, text(200)), ("en", None), (None, ""), ("fr", "."), ("en", text(300))] * 2


@pytest.mark.parametrize("most_words", [3, 4])
def test_phrases_brute_force(spark, most_words):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, "c", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = phrases.collocations(phrases.frequent_phrases(docs, most_words=most_words))
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, most_words=most_words))
    assert phrases.collocations(phrases.frequent_phrases(docs.limit(0))).collect() == []


@pytest.mark.parametrize("flush,slice_bytes", [(1, 7), (20, 16), (50, 1000), (10**6, 1)])
def test_lots_lose_no_phrase(flush, slice_bytes):
    """Lots and slices of any size give the same counts, long texts without an end of a piece included."""
    rows = [*phrase_rows(), ("en", "a b c d e f g " * 40), ("en", "w" * 300), ("en", "a  \t b. c")]

    def counts(made):
        f = Counter()
        batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["lang", "text"])
        for words, lot in made.lots(iter([batch])):
            for lang, (numbers, told) in lot.items():
                f[lang, ()] += int((numbers != 0).sum()) - told
                for size in (1, 2, 3):
                    for i in phrases._spans((numbers, told), size):
                        f[lang, tuple(words[x] for x in numbers[i : i + size])] += 1
        return f

    assert counts(phrases.Tokens(3, flush, slice_bytes)) == counts(phrases.Tokens(3, 10**9, 10**9))


def test_sketch_never_underestimates(spark):
    """With a sketch of few cells many n-grams share a cell: none that is frequent is lost."""
    rows = [("en", " ".join(f"w{random.Random(k).randrange(3000)}" for k in range(i * 999, i * 999 + 999))) for i in range(30)]
    texts = spark.createDataFrame(rows, "lang string, text string")
    maps, bits, folded = phrases.frequent_cells(texts, least=4)
    full = Counter(w for _, t in rows for w in t.split())
    often = [w for w, n in full.items() if n >= 4]
    table = phrases._word_table([b".", *[w.encode() for w in often]])
    h = phrases._hashes("en", np.arange(1, len(often) + 1), np.arange(len(often)), 1, table)
    for row in range(phrases.DEPTH):
        at = (phrases._cells(h, row, bits) & np.uint64((1 << folded) - 1)).astype(np.int64)
        assert ((maps[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all()
    assert np.unpackbits(maps[0]).sum() < 2 * len(often) + 100


def plain_tree(texts, asked, depth):
    """log10 probabilities of texts under context trees kept as a dictionary from (bytes of context, path) to counts."""
    low = lambda t: b"\xff" * depth + (t or "").encode().lower() + b"\xff"
    n = Counter()
    for t in texts:
        raw = low(t)
        for i in range(depth, len(raw)):
            for j in range(8):
                path, bit = (1 << j) | (raw[i] >> (8 - j)), (raw[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    n[raw[i - d : i], path, bit] += 1
    nodes = {(c, p) for c, p, _ in n}
    children = {}
    for c, p in nodes:
        if c:
            children.setdefault((c[1:], p), []).append((c, p))
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, stop = {}, {}
    for c, p in sorted(nodes, key=lambda x: -len(x[0])):
        own = log_kt(n[c, p, 0], n[c, p, 1])
        below = sum(weighted[x] for x in children.get((c, p), []))
        top = max(own, below)
        weighted[c, p] = own if len(c) == depth else top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        stop[c, p] = 1.0 if len(c) == depth else math.exp(own - weighted[c, p]) / 2
    out = []
    for t in asked:
        raw, total = low(t), 0.0
        for i in range(depth, len(raw)):
            for j in range(8):
                path, bit = (1 << j) | (raw[i] >> (8 - j)), (raw[i] >> (7 - j)) & 1
                one = 0.5
                for d in range(depth, -1, -1):
                    c = raw[i - d : i]
                    if (c, path) in nodes:
                        a, b = n[c, path, 0], n[c, path, 1]
                        one = stop[c, path] * (b + 0.5) / (a + b + 1) + (1 - stop[c, path]) * one
                total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def plain_base(texts, asked):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for t in texts for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for t in asked]


TEXTS = ["The cat sat on the mat.", "the dog sat on the log", "", None, "a" * 60, "Größe und Maß\tund  mehr\n", "the cat sat on the mat.", "\x00\x1f odd \x85 bytes", "THE THE THE the", "x"]


@pytest.mark.parametrize("depth,lot,most_nodes,top_words", [(5, 1 << 23, 10**6, 10**5), (2, 11, 10**6, 2), (3, 7, 0, 0), (1, 30, 0, 3), (0, 5, 10**6, 1)])
def test_context_trees_brute_force(spark, depth, lot, most_nodes, top_words):
    """Sent and shuffled models, whole texts and slices, give the brute-force scores."""
    rows = [(k, t, "c", 0.5) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1], "c", 0.5), (None, TEXTS[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, score double").repartition(3)
    learn = docs.where("doc_id is null or doc_id < 7")
    texts = [t for k, t, *_ in rows if k is None or k < 7]
    got = context_tree.score_texts(docs, learn, depth=depth, lot=lot, most_nodes=most_nodes, top_words=top_words).collect()
    tree, base = plain_tree(texts, [r[1] for r in rows], depth), plain_base(texts, [r[1] for r in rows])
    want = sorted(((-1 if r[0] is None else r[0]), *base[i], tree[i]) for i, r in enumerate(rows))
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-5, abs=1e-6)


def test_context_trees_without_training(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    row = context_tree.score_texts(docs, docs.limit(0)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == 0 and row["score"] == pytest.approx(40 * math.log10(0.5)) and row["bits_per_byte"] == pytest.approx(8)
    assert context_tree.score_texts(docs.limit(0), docs.limit(0)).collect() == []


def test_probabilities_add_up(spark):
    """The next byte's 256 probabilities add up to one, in a context that was seen and in one that was not."""
    counts = context_tree.corpus_counts(spark.createDataFrame([("abracadabra",), ("abba",)], "text string"), 3)
    trees = [context_tree._sorted(t.toArrow()) for t in context_tree.context_trees(counts.where("word is null"), 3)[0]]
    for context in (b"bra", b"zzz", b"\xff\xffa"):
        every = (int.from_bytes(context, "big") << 8) | np.arange(256)
        assert (10 ** context_tree.log10_bytes(every, trees)).sum() == pytest.approx(1)


def test_lm_query(spark, sf):
    """Held-out texts are coded in fewer bits than the eight of their bytes, and known texts in fewer than they."""
    rows = Q.op13_lm_scoring(spark, sf).groupBy("held_out").agg(F.count("*").alias("n"), (F.sum(F.col("bits_per_byte"))).alias("b")).collect()
    mean = {r["held_out"]: r["b"] / r["n"] for r in rows}
    assert mean[False] < mean[True] < 3.5


def test_lm_scores_keep_up_with_the_base(spark, sf):
    """No text, held out or not, is more than log10(2) behind the unigram base or the trees, and every score is finite."""
    for r in Q.op13_lm_scoring(spark, sf).collect():
        assert math.isfinite(r["score"]) and max(r["base_score"], r["tree_score"]) - math.log10(2) - 1e-9 <= r["score"] <= max(r["base_score"], r["tree_score"]) + 1e-9


def test_never_seen_is_not_impossible(spark):
    """After a byte that came 10^9 times alone any other has a probability: a float has none between 1 - 10^-9 and one."""
    counts = spark.createDataFrame([(ord("o"), 10**9)], "code long, n long")
    trees = [context_tree._sorted(t.toArrow()) for t in context_tree.context_trees(counts, 0)[0]]
    every = 10 ** context_tree.log10_bytes(np.arange(256), trees)
    assert (every > 0).all() and every.sum() == pytest.approx(1)


def test_known_strings_are_looked_up_in_the_deepest_tree_alone(spark, monkeypatch):
    """Strings of the training take eight look-ups each, one a bit, and have the scores that the trees give when they are walked from node to node."""
    learn = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    strings = context_tree.corpus_counts(learn, 3).where("word is null").select("code", "n")
    trees = [context_tree._sorted(t.toArrow()) for t in context_tree.context_trees(strings, 3)[0]]
    codes = np.sort(np.array([r["code"] for r in strings.collect()]))
    scores, plain, asked = context_tree.Scores(context_tree.settled(trees)), np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda keys, key, *more: asked.append(len(np.atleast_1d(key))) or plain(keys, key, *more))
    got = scores.of(codes)
    assert sum(asked) <= 9 * len(codes)  # one more in the memory
    walked = []
    for code in codes.tolist():
        total = 0.0
        for j in range(8):
            path, one = (1 << j) | ((code & 255) >> (8 - j)), 0.5
            for d in range(3, -1, -1):
                keys, p, stop = trees[d]
                key = (((code >> 8) & ((1 << (8 * d)) - 1)) << 8) | path
                at = int(plain(keys, key))
                if at < len(keys) and keys[at] == key:
                    share, own = float(stop[at]), float(p[at])
                    one = share * (1 + own if own < 0 else own) + (1 - share) * one
            total += math.log10(one if (code >> (7 - j)) & 1 else 1 - one)
        walked.append(total)
    assert got == pytest.approx(np.array(walked), rel=1e-12)


def test_words_that_are_sent_take_no_rows():
    """Counts, the base and the other words of a text, also where a word is cut between slices."""
    import pyarrow as pa

    known = type("Sent", (), {"value": {b"the": 1.5, b"": 0.25}})
    context = type("Context", (), {"get": staticmethod(lambda: context), "partitionId": staticmethod(lambda: 0)})
    real, context_tree.TaskContext = context_tree.TaskContext, context
    try:
        found = list(context_tree._score(2, 5, known, None)(iter([pa.RecordBatch.from_pydict({"id": ["1"], "text": ["The other the other x"]})])))
    finally:
        context_tree.TaskContext = real
    rows = [r for batch in found for r in batch.to_pylist()]
    assert (sum(r["n_tokens"] for r in rows), sum(r["n_known"] for r in rows), sum(r["base"] for r in rows)) == (6, 3, 3.25)
    assert sorted((e["word"], e["n"]) for r in rows for e in r["rare"]) in ([("other", 1), ("other", 1), ("x", 1)], [("other", 2), ("x", 1)])
