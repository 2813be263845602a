"""The pair scorer, all routes of a question, and the evaluation's rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import answer as A
from quarry.operators import pairs as PA


def plain_interaction(asked, words):
    grams = lambda t: {f"^{t}$"[i : i + 3] for i in range(len(t))}
    cosine = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    return sum(max(cosine(a, w) for w in words) for a in asked) / len(asked) if asked and words else None


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_interaction(monkeypatch, size):
    monkeypatch.setattr(PA, "SLICE", size)
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 6)))
    for _ in range(200):
        asked, words = sorted({word() for _ in range(rng.randint(0, 4))}), sorted({word() for _ in range(rng.randint(0, 9))})
        assert PA.interaction(asked, words) == pytest.approx(plain_interaction(asked, words))
    assert PA.interaction(["abc"], ["xyz"]) == 0 and PA.interaction(["abc"], ["abc", "abd"]) == pytest.approx(1)


def test_score_pairs_odd(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (1, 9), (4, 4)], "q long, node_id long")
    questions = spark.createDataFrame([(1, "Green apples"), (2, None), (3, "the of"), (4, "word")], "q long, text string")
    texts = spark.createDataFrame([(1, "green APPLES and pears"), (2, None), (3, ""), (4, "word " * 50_000 + "wordy")], "node_id long, text string")
    got = {(r["q"], r["node_id"]): r["scored"] for r in PA.score_pairs(pairs, questions, texts).collect()}
    assert got[1, 1] == pytest.approx(1) and got[4, 4] == pytest.approx(1) and [got[k] for k in ((1, 2), (1, 3), (2, 1), (3, 1), (1, 9))] == [None] * 5


WORDS = "tell me more about the way in which all of the apples that grow in the green garden behind the old house are sold"


def test_routes(spark):
    """Asked back, chatted with, answered, refused for want of citations, and nothing found; a blank question fails in the evaluation."""
    rows = [(1, "short"), (2, f"{WORDS} é"), (3, WORDS), (4, f"{WORDS} twice"), (5, f"{WORDS} nothing"), (6, f"{WORDS} {WORDS}"), (7, "  ")]
    asked = spark.createDataFrame(rows, "q long, text string").withColumn("reply", A.rule_reply(F.col("text")))

    def sources_of(routed):
        hits = routed.where("q <> 5").select("q", F.lit(1).alias("rank"), F.lit("n1").alias("node_id"), F.lit("d").alias("doc"), F.lit("f.pdf").alias("filename"), F.lit(0.5).alias("score"), F.lit("Apples are sold.\nMore").alias("text"), F.lit("text").alias("kind"))
        return A.sources(hits)

    def complete(context):
        return A.extractive(context).withColumn("first", F.when(F.col("q") == 4, "No source here.").otherwise(F.col("first"))).withColumn("second", F.when(F.col("q") == 4, "Still none [S9].").otherwise(F.col("second")))

    responses = A.respond(asked, sources_of, complete).cache()
    got = {r["q"]: (r["route"], r["response"], r["source_ids"]) for r in responses.collect()}
    assert got == {
        1: ("clarify", A.CLARIFY, []), 2: ("chat", A.CHAT, []), 3: ("retrieve", "Apples are sold. [S1]", ["S1"]), 4: ("retrieve", A.REFUSAL, ["S1"]), 5: ("retrieve", A.NOTHING, []), 6: ("retrieve", "Apples are sold. [S1]", ["S1"]), 7: ("clarify", A.CLARIFY, []),
    }
    cases = {r["case_id"]: r for r in A.case_rows(responses).collect()}
    assert [cases[k]["ok"] for k in range(1, 8)] == [True] * 6 + [False] and cases[7]["answer_chars"] == 0
    assert (cases[3]["cited_ids"], cases[3]["cited"], cases[3]["valid"], cases[3]["source_count"], cases[3]["overlap"]) == ("S1", True, True, 1, 1.0)
    assert (cases[4]["cited"], cases[4]["valid"], cases[2]["overlap"], cases[5]["source_count"]) == (False, False, 0.0, 0)
    means = A.eval_summary(A.case_rows(responses)).first()
    assert means["cases"] == 7 and means["ok_rate"] == pytest.approx(6 / 7) and means["valid_rate"] == pytest.approx(2 / 7)


def test_own_chat(spark):
    asked = spark.createDataFrame([(1, f"{WORDS} é")], "q long, text string").withColumn("reply", A.rule_reply(F.col("text")))
    empty = lambda routed: A.sources(routed.select("q", F.lit(1).alias("rank"), F.lit("n").alias("node_id"), F.lit("d").alias("doc"), F.lit("f").alias("filename"), F.lit(0.5).alias("score"), F.lit("t").alias("text"), F.lit("text").alias("kind")))
    assert A.respond(asked, empty, chat=lambda talk: talk.withColumn("said", F.concat(F.lit("you said "), F.length("text")))).first()["response"] == f"you said {len(WORDS) + 2}"
