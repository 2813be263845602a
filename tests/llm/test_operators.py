import base64
import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, license_scan, mixing, simhash, suffixes, toxicity, url_filter, warc, webp
from quarry.llm import queries as Q

CLASHES = ["key", "fp", "words", "copy", "score", "part", "h", "n", "spans", "mix_key", "item_id", "run"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, a repeated id, and columns whose names operators use."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (4, long, "b"), (5, long, "b"), (6, "é" * 300 + " ü", "a"), (7, "x " * 500, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(0).cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHES])


def results(spark, df):
    bench = spark.createDataFrame([(0, "one two"), (1, None), (2, ""), (3, " ".join(f"w{k}" for k in range(100, 130)))], "item_id long, text string")
    chain = toxicity.Chain({"w:one": 0}, np.array([9.0]), -5.0, np.zeros((2, 2)))
    return {
        "license": license_scan.license_scan(df), "toxicity": toxicity.toxicity(df, chain), "clean": toxicity.keep_clean(df, chain), "digest": suffixes.dedup_digest(df), "text": suffixes.dedup_text(df),
        "simhash": simhash.near_duplicates(df), "media": webp.read_media(webp.write_media(df)), "mix": mixing.poisson_mix(df), "leaks": decontaminate.contaminated(df, bench), "keep": simhash.keep_one(df),
    }


def test_odd_rows(spark, odd):
    got = {k: v.collect() for k, v in results(spark, odd).items()}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for name in ("license", "toxicity", "digest", "text", "simhash", "media"):
        assert len(got[name]) == 8, name
    assert [r["n_words"] for r in got["license"] if r["doc_id"] == 1] == [0]
    assert {r["doc_id"]: r["predicted"] for r in got["toxicity"]} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert {r["doc_id"] for r in got["clean"]} == {1, 2, 4, 5, 6, 7} and got["clean"][0]["key"] == "clash"
    digest = {r["doc_id"]: r for r in got["digest"]}
    assert digest[5]["n_removed"] == digest[5]["n_bytes"] and digest[4]["n_removed"] == 0 and digest[7]["n_removed"] > 800
    assert {r["doc_id"]: r["text"] for r in got["text"]}[1] is None and set(got["text"][0].asDict()) == set(odd.columns)
    components = {r["doc_id"]: r["component_id"] for r in got["simhash"]}
    assert components[5] == 4 and components[2] == 1 and components[3] == 3
    assert {r["doc_id"] for r in got["keep"]} == {1, 3, 4, 6, 7} and len(got["keep"]) == 5
    assert {(r["doc_id"], r["item_id"]) for r in got["leaks"]} == {(3, 0), (4, 3), (5, 3)}
    for r in got["media"]:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["n_bytes"] == len(text) and r["pixels"] == text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))


def test_empty_table(spark, odd):
    assert {k: v.count() for k, v in results(spark, odd.limit(0)).items()} == dict.fromkeys(results(spark, odd.limit(0)), 0)


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_oracle(name, same):
    same(Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_license_brute_force(spark):
    rng = random.Random(1)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "x1"]
    texts = ["".join(rng.choice(pool).upper() + rng.choice([" ", "-", ".\n", "/"]) if rng.random() < 0.5 else rng.choice(pool) + " " for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["Under the MIT License under the mit license", "CC BY-NC 4.0", "Apache License, Version 2.0"]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want = (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert tuple(got[k])[1:6] == want


def test_license_expressions():
    assert license_scan.to_postfix("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or"]
    assert license_scan.evaluate("(MIT OR GPL-3.0-only) AND Apache-2.0") == ({"mit", "gpl", "apache-2"}, True)
    assert license_scan.evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, False)
    for bad in ("", "MIT OR", "(MIT", "AND MIT", "MIT)"):
        with pytest.raises(ValueError):
            license_scan.evaluate(bad)
    found = license_scan.scan(b"# SPDX-License-Identifier: MIT OR MPL-2.0\n", license_scan.automaton())
    assert found[5] == "mit,mpl" and found[7] is True and 0.9 < found[6] <= 1


@pytest.mark.parametrize("after", [" -->", " see the file COPYING", " */ text"])
def test_license_tag_before_prose(after):
    for expression, want in (("MIT OR Apache-2.0", ("apache-2,mit", True)), ("MIT AND GPL-3.0-only", ("gpl,mit", False)), ("(MIT OR MPL-2.0)", ("mit,mpl", True)), ("GPL-2.0-only WITH Classpath-exception-2.0", ("gpl", False))):
        found = license_scan.scan(f"<!-- SPDX-License-Identifier: {expression}{after}\n".encode(), license_scan.automaton())
        assert (found[5], found[7]) == want and found[6] > 0.9
    with pytest.raises(ValueError):
        license_scan.evaluate("(MIT OR MPL-2.0 text)")


def test_license_identifiers():
    scan = lambda e: license_scan.scan(f"SPDX-License-Identifier: {e}\n".encode(), license_scan.automaton())[5]
    for text, want in (("see file", ""), ("Mitre-Foo", "mitre-foo"), ("MIT-0", "mit"), ("ISC", "isc"), ("GPLv3", "gpl"), ("", ""), ("12", ""), ("Foo-1.0+ OR see", "foo-1.0")):  # the longest whole expression stays
        assert scan(text) == want, text


PROBES = [
    ("// (SPDX-License-Identifier: MIT)", "mit"), ("SPDX-License-Identifier: MIT (see LICENSE)", "mit"), ("SPDX-License-Identifier: MIT or later versions", "mit"),
    ("SPDX-License-Identifier: MIT and other stuff", "mit"), ("SPDX-License-Identifier: MIT OR", "mit"), ("SPDX-License-Identifier: Intel OR MIT", "intel,mit"),
    ("SPDX-License-Identifier: MIT/Apache-2.0", "apache-2,mit"), ("SPDX-License-Identifier: (MIT OR", ""), ("SPDX-License-Identifier: OR MIT", ""),
    ("SPDX-License-Identifier: (MIT OR ISC) AND (MPL-2.0 AND foo", "isc,mit"), ("SPDX-License-Identifier: MIT)) OR ISC", "mit"),
]


def test_license_longest_prefix(spark):
    """On a table: of what follows a tag the longest whole expression counts."""
    rows = spark.createDataFrame([(k, f"{t}\nmore text") for k, (t, _) in enumerate(PROBES)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(rows).collect()}
    for k, (text, want) in enumerate(PROBES):
        assert got[k]["labels"] == want and (got[k]["score"] > 0.9) == bool(want), text


def test_license_longest_prefix_brute_force():
    """Against a recursive reader of all prefixes."""
    def value(tokens):
        def expr(i, rank):
            if rank == 4:
                if i < len(tokens) and tokens[i] == "(":
                    v, i = expr(i + 1, 1)
                    if i >= len(tokens) or tokens[i] != ")":
                        raise ValueError
                    return v, i + 1
                if i >= len(tokens) or tokens[i] not in ("mit", "gpl-2.0", "isc"):
                    raise ValueError
                return tokens[i] in ("mit",), i + 1
            v, i = expr(i, rank + 1)
            op = {1: "or", 2: "and", 3: "with"}[rank]
            while i < len(tokens) and tokens[i] == op:
                w, i = expr(i + 1, rank + 1)
                v = v or w if rank == 1 else v and w if rank == 2 else v
            return v, i

        v, i = expr(0, 1)
        if i < len(tokens):
            raise ValueError
        return v

    rng = random.Random(2)
    for _ in range(3000):
        tokens = [rng.choice(["mit", "gpl-2.0", "isc", "or", "and", "with", "(", ")", "prose", "mit"]) for _ in range(rng.randint(0, 9))]
        want = 0
        for n in range(len(tokens), 0, -1):
            try:
                free = value(tokens[:n])
            except ValueError:
                continue
            want = n
            break
        postfix, n = license_scan.longest_prefix(tokens)
        assert n == want, tokens
        if n:
            assert license_scan._value(postfix)[1] == free, tokens


def test_license_phrase_expressions(spark, sf):
    texts = {
        "Released under the MIT license or under the Apache License, Version 2.0.": True, "under the mit license and the gnu general public license": False, "under the mit license or the GNU General Public License": True,
        "gnu general public license or under the mit license and mozilla public license": False, "under the mit license. " + "word " * 30 + "gnu general public license": False, "cc by nc": False, "nothing": None,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["permissive"] for r in license_scan.license_scan(rows).orderBy("doc_id").collect()] == list(texts.values())


def test_license_labels_brute_force():
    """Labels and score of phrases, against a plain search for each phrase; many matches in one long text."""
    phrases = {**license_scan.BASE_PHRASES, **license_scan.OWN_PHRASES}
    rng = random.Random(7)
    pool = sorted({w for p in phrases for w in p.split()} | {"x", "é"})
    matcher = license_scan.automaton()
    texts = [" ".join(rng.choice([rng.choice(pool), rng.choice(list(phrases))]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for text in [*texts, "cc by nc " * 100_000]:
        words = text.split()
        at = [(i, x) for p, x in phrases.items() for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split()] if len(words) < 1_000 else [(3 * k, "cc-by-nc") for k in range(100_000)]
        found = license_scan.scan(text.encode(), matcher)
        base = [i for i, x in at if x in license_scan.BASE_PHRASES.values()]
        assert found[1:4] == (len(base), min(base, default=None), max(base, default=None))
        assert found[5] == ",".join(sorted({x for _, x in at})) and found[6] == pytest.approx(1 - 0.2 ** len(at))


def test_forward_backward():
    rng = np.random.default_rng(1)
    moves, lengths = rng.normal(size=(2, 2)), [1, 3, 5, 2, 7, 1, 9]
    e = rng.normal(size=sum(lengths)) * 2
    first, want, at = np.zeros(len(e), bool), [], 0
    for n in lengths:
        first[at] = True
        mass = np.zeros((2, n))
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags)))
            for i, t in enumerate(tags):
                mass[t, i] += w
        want += list(mass[1] / mass.sum(0))
        at += n
    for block in (2, 4, 64):
        assert np.allclose(toxicity.forward_backward(e, first, moves, block), want)


def test_pair_marginals():
    """The gradient's expected pairs of tags, against enumeration; texts of one word have none."""
    rng = np.random.default_rng(2)
    moves, lengths = rng.normal(size=(2, 2)), [1, 3, 6, 1, 2]
    e, first, at, want = rng.normal(size=sum(lengths)) * 2, np.zeros(sum(lengths), bool), 0, np.zeros(4)
    for n in lengths:
        first[at], total, pairs = True, 0.0, np.zeros(4)
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            for a, b in itertools.pairwise(tags):
                pairs[2 * a + b] += w
        want += pairs / total
        at += n
    for block in (2, 64):
        p, pairs = toxicity.marginals(e, first, moves, block)
        assert np.allclose(pairs, want) and np.allclose(p, toxicity.forward_backward(e, first, moves, block))


def test_toxicity_spans_and_neighbours():
    chain = toxicity.Chain({"w:bad": 0}, np.array([[9.0], [4.0], [-2.0]]), -5.0, np.zeros((2, 2)))
    for text, word in (("İİ bad word", "bad"), ("aİa bad", "bad"), ("x BAD", "BAD"), ("漢 bad", "bad")):
        (score, hits, spans, *_), = toxicity.score_texts(chain, [text.encode()])
        assert hits == 1 and text[spans[0]["start"] : spans[0]["end"]] == word
    words = ["a", "bad", "b", "bad"]
    e = chain.emissions(words, np.array([True, False, False, True]))
    assert e.tolist() == [-7.0, 4.0, -1.0, 4.0]  # the last word stands in a text of its own


def test_toxicity_fits_odd_tables(spark):
    long = "nasty " * 20_000
    rows = [(k, "nasty words here" if k % 2 else "kind words here " + str(k)) for k in range(80)] + [(1, None), (3, ""), (None, "x"), (5, "nasty words here"), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(1, 0), (None, 1), (4, None), (999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    chain = toxicity.fit(docs.withColumn("label", F.lit(1)), labels)
    assert 0 <= toxicity.toxicity(docs, chain).where("score is null or score < 0 or score > 1").count() == 0
    few = toxicity.fit(docs, labels, most_features=1, chain_chars=40, max_fit_chars=1_000)
    assert len(few.index) <= 1
    for empty in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels, chain_rows=0)):
        assert toxicity.toxicity(docs, empty).where("predicted = 1").count() == 0


def test_toxicity_recall(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    n = Q.op2_toxicity(spark, base).where("held_out").join(labels, "doc_id").agg(F.sum("toxic").alias("toxic"), F.sum(F.expr("toxic * predicted")).alias("found"), F.sum(F.expr("(1 - toxic) * predicted")).alias("wrong"), F.count("*").alias("n")).first()
    assert n["found"] >= 0.9 * n["toxic"] and n["wrong"] <= 0.01 * n["n"], n


def test_toxicity_held_out(spark, sf):
    base = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = Q.op2_toxicity(spark, base).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9
    assert sum(r["predicted"] for r in held if not labels[r["doc_id"]]) <= 2
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]]]) >= 0.6
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, chain).first()["predicted"] == 0


def test_warc(spark):
    rows = [(k, f"http://x/{k}\r\nEvil: 1", t) for k, t in enumerate(["a" * 900, None, "", "a" * 900, "é", "é", *[f"<p>page {k}</p>" * 50 for k in range(60)]])]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r["page_id"]: r for r in warc.read_archives(archives).collect()}
    first = {}
    for k, _, t in rows:
        data = (t or "").encode()
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["refers_to"] == (first.get(data)) and r["record_type"] == ("revisit" if data in first else "response")
        first.setdefault(data, k)


def test_warc_rejects():
    record = warc.build_record(1, "http://x", b"data", None)
    archive = warc.pack([record] * 300)
    assert archive[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.unpack(archive)) == [record] * 300
    data = warc.zstandard.train_dictionary(4096, [record] * 300).as_bytes()
    packed = zstandard.ZstdCompressor().compress(data)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data)).compress(record)
    assert list(warc.unpack((0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + frame)) == [record]
    for bad in (record.replace(b"WARC/1.1", b"WARC/9"), record[:-1], record + b"x", record.replace(b"data", b"dada"), record.replace(b"WARC-Date", b"WARC Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (archive[:-5], archive + b"junk", archive + (0x184D2A5A).to_bytes(4, "little"), archive + (0x184D2A5A).to_bytes(4, "little") + b"\xff\0\0\0abc"):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.unpack(bad))


def test_warc_false_revisits(spark):
    """A revisit whose response is missing, or has another length or digest, is rejected; a true one is not."""
    response, true = warc.build_record(1, "http://x", b"data", None), warc.build_record(2, "http://x", b"data", 1)
    read = lambda *records: warc.read_archives(spark.createDataFrame([(bytearray(warc.pack([r])),) for r in records], "content binary"))
    assert read(response, true).count() == 2
    for bad in (true.replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5"), true.replace(b"X-Refers-To-Page: 1", b"X-Refers-To-Page: 3"), warc.build_record(2, "http://x", b"datb", 1)):
        with pytest.raises(warc.WarcError):
            read(response, bad)
    for bad in (true.replace(b"X-Payload-Length: 4\r\n", b""), true.replace(b"WARC-Type: revisit", b"WARC-Type: rumour")):
        with pytest.raises(Exception, match="neither a response nor a revisit"):
            read(response, bad)


def test_pages_odd(spark):
    """Null, repeated and very long pages, urls and ids, clashing columns, and empty tables."""
    long = "<p>" + "z" * 10_000_000
    rows = [(1, "http://A.com/x", "same"), (1, "http://A.com/x", "same"), (2, None, "same"), (None, "no url", "same"), (3, "http://b.net/fr/" + "y/" * 50_000, long), (4, "://", None), (5, "http://b.net/fr/?q#f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("digest", "data", "n", "first_id", "host", "rule", "path", "content")])
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == sorted([(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (-1, 4, "response", None), (3, len(long), "response", None), (4, 0, "response", None), (5, 0, "revisit", 4)], key=lambda x: (x[0], x[1]))
    urls = {r["page_id"]: (r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in url_filter.url_filter(pages).collect()}
    assert urls == {1: ("a.com", 2, "com/", "allow"), 2: ("", 0, None, "allow"), None: ("", 0, None, "allow"), 3: ("b.net", 100_004, "net/fr/", "block"), 4: ("", 0, None, "allow"), 5: ("b.net", 4, "net/fr/", "block")}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0 == url_filter.url_filter(pages.limit(0)).count()
    ties = url_filter.url_filter(spark.createDataFrame([(1, "http://x.a.b/")], "page_id long, url string"), [("block", "a.b/"), ("allow", ".b/x/"), ("allow", "a.b/")])
    assert ties.first()["verdict"] == "block"


def test_shared_dir_on_a_cluster(spark, monkeypatch):
    """Without a named folder, a cluster gets an error instead of a folder of one machine."""
    from quarry.llm import common

    class Stub:
        conf, master = {}, "spark://host:7077"

        @property
        def sparkContext(self):
            return self

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Stub())


def test_shift_and():
    globs = ["*.com/**", "a*b", "**x*y/**", "abc", "*" + "q" * 70 + "*"]
    machine, rng = url_filter.ShiftAnd(globs), random.Random(2)
    texts = ["".join(rng.choice("abxy/.comq") for _ in range(rng.randint(0, 14))).encode() for _ in range(3000)] + [b"abc", b".x.com/", b"a" + b"q" * 71, b""]
    as_regex = [re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*?)", g)), re.S) for g in globs]
    want = [[bool(p.fullmatch(t.decode())) for p in as_regex] for t in texts]
    assert machine.matches(texts).tolist() == want


def cover_brute_force(docs):
    seen, out = set(), {}
    for key, data in sorted(docs):
        gone = np.zeros(len(data), bool)
        for q in range(len(data) - suffixes.LENGTH + 1):
            if (w := data[q : q + suffixes.LENGTH]) in seen:
                gone[q : q + suffixes.LENGTH] = True
            seen.add(w)
        out[key] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffixes_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(6)] + ["x" * 400, "ab" * 300, "é" * 120]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) - 1)
            parts.append(b[a : rng.randint(a, len(b))] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))))
        texts.append("".join(parts))
    docs = [(k - 3, t) for k, t in enumerate([*texts, texts[50], "", texts[50][:99]])]
    want = cover_brute_force([(k, t.encode()) for k, t in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r[0]: tuple(r[1:]) for r in suffixes.dedup_digest(df).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in suffixes.dedup_text(df).collect()}
    for k, t in docs:
        assert "�" not in kept[k] and len(kept[k].encode()) >= want[k][0] - want[k][1]
        if t.isascii():
            assert hashlib.sha256(kept[k].encode()).hexdigest() == want[k][3]


LONG_LINE = "".join(map(random.Random(300).choice, ["abcdefghijklmnop"] * 300))


@pytest.mark.parametrize("ids", [(1, 1), (None, None), (1, None), (None, None, None, 2)])
def test_suffixes_repeated_rows(spark, ids):
    """Rows of equal id and text are one text: nothing of it goes, in neither row; what other texts repeat of it goes there."""
    rows = [(i, LONG_LINE) for i in ids] + [(5, "x" + LONG_LINE[:150] + "y"), (5, "z" + LONG_LINE[20:200])]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        first = min((-1 if i is None else i) for i in ids)
        gone = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.dedup_digest(table).collect()}
        assert gone == {**{(i, 300): 0 if (-1 if i is None else i) == first else 300 for i in ids}, (5, 152): 150, (5, 181): 180}
        kept = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in suffixes.dedup_text(table).collect())
        assert kept == sorted([((-1 if i is None else i), LONG_LINE if (-1 if i is None else i) == first else "") for i in ids] + [(5, "xy"), (5, "z")])


def test_suffix_merge_in_passes(monkeypatch, tmp_path):
    """More runs than are merged at once: passes of bounded width give the same items and shared prefixes, from memory and from a file."""
    blobs = [b.column(0)[0].as_py() for b in _hot_runs(600, 40)]
    plain = lambda pairs: [((x[0], *x[2:]), shared) for x, shared in pairs]  # without the prefix shared within its old run
    want = plain(suffixes.merge([suffixes.run_items(b) for b in blobs]))
    assert len(want) == 600 and len(blobs) == 15
    for width, block, held in ((2, 7, 0), (3, 1000, 1 << 20), (4, 1, 500), (15, 7, 0)):
        monkeypatch.setattr(suffixes, "MERGE_WIDTH", width), monkeypatch.setattr(suffixes, "BLOCK_ITEMS", block), monkeypatch.setattr(suffixes, "HELD_BYTES", held)
        with (tmp_path / f"{width}").open("w+b") as spilled:
            runs = suffixes._Runs(spilled)
            runs.all = [[(runs.kept(b), 0)] for b in blobs]
            assert plain(runs.narrowed()) == want


def test_suffix_pieces():
    """A text dealt in pieces has the same windows as a whole one."""
    data = b"".join(bytes([97 + (k * k) % 7]) for k in range(2000))
    whole = suffixes.picks(np.frombuffer(data, np.uint8), np.array([len(data)]))
    assert (whole[1] - whole[0] + 1).sum() == len(data) - 99
    places = np.repeat(whole[2], whole[1] - whole[0] + 1)
    for offset in (0, 700):
        piece = data[offset : offset + 700 + 99]
        part = suffixes.picks(np.frombuffer(piece, np.uint8), np.array([len(piece)]))
        assert (np.repeat(part[2], part[1] - part[0] + 1) + offset == places[offset : offset + 700]).all()


def test_loser_tree():
    rng = random.Random(4)
    for n in (1, 2, 3, 7):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(n)]
        blobs = [suffixes.front_code(r, np.zeros(len(r)), np.arange(len(r)), [b"k"] * len(r)) for r in runs if r]
        out = list(suffixes.merge([suffixes.run_items(b) for b in blobs]))
        assert [x[0][0] for x in out] == sorted(itertools.chain(*runs))
        for (a, _), (b, shared) in itertools.pairwise(out):
            assert shared == suffixes._mismatch(a[0], b[0], 0)


LOG = [(1, 0, "open", "user", ""), (1, 1, "delta", "", "Hel"), (1, 2, "delta", "", "lo"), (1, 9, "edit", "", "Hi"), (2, 3, "open", "assistant", ""), (2, 4, "delta", "", "draft"), (2, 6, "regenerate", "", ""), (2, 7, "delta", "", "<|end|>~1"), (3, 5, "open", "user", ""), (3, 8, "delete", "", ""), (4, 10, "delta", "", "never opened"), (5, 11, "open", "assistant", None), (5, 12, "shrug", "", "x"), (5, 12, "delta", None, None)]


@pytest.mark.parametrize("most_bytes", [chat.MOST_BYTES, 10])
def test_chat_events(spark, most_bytes):
    """An arbitrary log of two conversations, events of messages interleaved, through fold, render and parse."""
    events = spark.createDataFrame([(c, m, s, k, r, t) for c in (9, None) for m, s, k, r, t in LOG], "conv_id long, message int, seq int, kind string, role string, text string")
    want = [("user", "Hi"), ("assistant", "<|end|>~1"), ("assistant", "")]
    final = chat.fold(events.repartition(3)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in final] == [(c, *x) for c in (None, 9) for x in want]
    pieces = chat.parse(chat.render(events.repartition(5), most_bytes, 8)).orderBy("conv_id", "piece").collect()
    for conv in (9, None):
        own = [r for r in pieces if r["conv_id"] == conv]
        assert [(t["role"], t["text"]) for r in own for t in r["turns"]] == want and (len(own) == 1) == (most_bytes > 10)
    found = {r["conv_id"]: r for r in chat.digests(chat.parse(chat.render(events, most_bytes, 8))).collect()}
    assert len(found) == 2 and found[9]["n_turns"] == 3 and found[9]["loss_chars"] == 9
    assert found[9]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
    assert found[None]["loss_sha256"] == hashlib.sha256(b"<|end|>~1").hexdigest()


@pytest.mark.parametrize("most_bytes", [chat.MOST_BYTES, 300])
def test_chat_hostile(spark, most_bytes):
    rows = [(1, 0, "user", chat.TURN + chat.BODY + "~0[|<" + chat.END, 0), (1, 1, "assistant", None, 0), (1, 1, "assistant", "x" * 1000 + chat.END, 0), (1, 1, "assistant", None, 0), (2, 0, "assistant", "", 0), (2, None, "tool|", "last", 0), (3, -5, None, "漢" * 401, 0), (3, 7, "user", "y" * 1_000_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {}
    for r in chat.parse(chat.render(chat.to_events(df), most_bytes)).orderBy("conv_id", "piece").collect():
        got.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
    assert got[1] == [("user", rows[0][3]), ("assistant", ""), ("assistant", ""), ("assistant", rows[2][3])]
    assert got[2] == [("assistant", ""), ("tool|", "last")] and got[3] == [("", rows[6][3]), ("user", rows[7][3])]
    assert chat.digests(chat.parse(chat.render(chat.to_events(df.limit(0)), most_bytes))).count() == 0


def test_webp_query_brute_force(spark, sf):
    """All contract columns of op8 on the whole table, and equal values for equal texts."""
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op8_webp(spark, sf).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        data = texts[r["doc_id"]]
        full = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        media = webp.encode(full)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), webp.feature(full))
        assert seen.setdefault(data, r[3:]) == r[3:]


def test_masks_cover():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(5)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differ & m for m in masks)
    for m in masks:
        finer, left = simhash.finer_masks(m), [b for b in range(64) if not m >> b & 1]
        assert all(f & m == m for f in finer) and {b for f in finer for b in range(64) if f >> b & 1} == set(range(64))
        for _ in range(50):
            differ = sum(1 << b for b in rng.sample(left, 4))
            assert any(not differ & f for f in finer)


def test_simhash_hot_buckets(spark):
    """A dense cluster beside scattered fingerprints, with buckets covered again several times: the same components as by all pairs."""
    rng = random.Random(1)
    base, fps = rng.getrandbits(64), {rng.getrandbits(64) for _ in range(200)}
    while len(fps) < 700:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(28), rng.randint(0, 9))))
    fps = sorted(fps)

    def components(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v in pairs:
            u, v = sorted((find(u), find(v)))
            root[v] = u
        return [find(x) for x in fps]

    want = components((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for block in (4096, 40):
        pairs = [(r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in simhash.near_edges(df, 4, block).collect()]
        assert components(pairs) == want


def print_of(text):
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [4096, 20])
def test_simhash_brute_force(spark, sf, block, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    prints = {r["doc_id"]: print_of((r["text"] or "").encode()) for r in docs.collect()}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    monkeypatch.setattr(simhash.near_edges, "__defaults__", (4, block))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


def test_components_chain(spark):
    from quarry.llm.components import connected_components

    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_mixing(spark):
    docs = spark.createDataFrame([(k, "big" if k % 10 else "small", f"t{k}") for k in range(4000)], "doc_id long, source string, text string")
    n = {r["source"]: r["count"] for r in mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 200 and abs(n["big"] - 1000) < 120
    assert {r["source"] for r in mixing.poisson_mix(docs, {"small": 1.0}).select("source").distinct().collect()} == {"small"}
    one = mixing.poisson_mix(docs).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.poisson_mix(docs.repartition(7)).collect())) and [r["doc_id"] for r in one] != sorted(r["doc_id"] for r in one)


def test_mixing_tiny_source(spark, monkeypatch):
    """A source of one document among many is drawn over many rows, with the same numbers and copies as in one; repeated rows included."""
    rows = [(k, f"t{k}", "large") for k in range(4000)] + [(1, "only", "tiny"), (None, "none", None), (None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def drawn():
        return sorted(((r["doc_id"] or -1), r["text"], r["copy"], r["mix_key"]) for r in mixing.poisson_mix(docs).collect())

    monkeypatch.setattr(mixing, "PARTS_AT_ONCE", 10**6)
    want = drawn()
    n = sum(r[1] == "only" for r in want)
    assert 1000 < n < 1700 and [r[2] for r in want if r[1] == "only"] == list(range(1, n + 1))  # a mean of 4003 / 3
    for parts in (1, 7, 32):
        monkeypatch.setattr(mixing, "PARTS_AT_ONCE", parts)
        assert drawn() == want


def test_decontamination_is_native(spark, sf, capsys):
    Q.op10_decontaminate(spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def _hot_runs(n, size=3_000):
    """Runs of n items that differ to the left of the picked place and share all bytes to its right."""
    right = bytes(range(97, 123)) * 4
    items = sorted((right[:90] + hashlib.sha256(b"%d" % k).hexdigest().encode(), k) for k in range(n))
    for at in range(0, n, size):
        own = items[at::1][:size]
        blob = suffixes.front_code([t for t, _ in own], np.full(len(own), 90), np.zeros(len(own)), [b"%08d" % k for _, k in own])
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())], names=["run", "key", "span"])


def test_suffix_group_in_pieces():
    """A merging task holds a piece of a large group, not the group."""
    peaks = []
    for n in (6_000, 24_000):
        runs = list(_hot_runs(n))
        tracemalloc.start()
        rows = sum(b.num_rows for b in suffixes._merge_runs(iter(runs)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows > 0
    assert peaks[1] < 2 * peaks[0], peaks


def test_suffix_run_pieces():
    strings = sorted(b"%05d" % (k * k) * 5 for k in range(500))
    blob = suffixes.front_code(strings, np.full(500, 7), np.arange(500), [b"k" * (k % 9) for k in range(500)])
    whole = list(suffixes.run_items(blob))
    assert [x[0] for x in whole] == strings and all(list(suffixes.run_items(lambda: blob, p)) == whole for p in (1, 16, 499, 500))


def test_suffix_large_group_brute_force(spark):
    """A passage inside more documents than a piece holds; some left sides recur far apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(90))
    passage, lefts, rights = word() + word(), [word() for _ in range(3_000)], [word() for _ in range(3_000)]
    texts = [rng.choice(lefts) + passage + rng.choice(rights) for _ in range(5_000)]
    first, want = {}, {}
    for k, t in enumerate(texts):
        gone = set()
        for j in range(len(t) - 99):
            if first.setdefault(t[j : j + 100], (k, j)) != (k, j):
                gone.update(range(j, j + 100))
        want[k] = len(gone)
    got = suffixes.dedup_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want
