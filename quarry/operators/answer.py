"""From ranked candidates to contexts, answers with checked citations, and quality figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions.text import strip, trim_text

REFUSAL = "I do not have enough information in the indexed documents to answer with citations."


#: What stands for missing fields of a source.
UNKNOWN, NO_INDEX, NOT_APPLICABLE = "unknown", "?", "n/a"
#: Metadata of a source that may be missing, beside those with defaults of their own.
OPTIONAL = {"page_label": "string", "section_title": "string", "parent_id": "string", "table_id": "string", "schema_version": "int", "table_visual_status": "string"}


def sources(ranked: DataFrame, most: int = 5, most_chars: int = 1800) -> DataFrame:
    """Source rows of (q, rank, node_id, doc, filename, score, text, kind) and what there is of chunk_id, chunk_index, content_type and OPTIONAL: numbered S1..
    in order; whole tables are kept whole, other texts are cut. `doc` and `kind` are the source's doc_id and chunk_kind."""
    have = lambda name, kind="string": F.col(name).cast(kind) if name in ranked.columns else F.lit(None).cast(kind)
    numbered = ranked.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("n") <= most)
    text = strip(F.coalesce("text", F.lit("")))
    snippet = F.when(F.col("kind") == "table_parent", text).otherwise(trim_text(text, most_chars))
    content_type = F.coalesce(have("content_type"), F.lit("text"))
    return numbered.select(
        "q", F.concat(F.lit("S"), F.col("n")).alias("source_id"), F.col("node_id").cast("string").alias("node_id"), F.coalesce("doc", F.lit(UNKNOWN)).alias("doc"), F.coalesce("filename", F.lit(UNKNOWN)).alias("filename"),
        F.coalesce(have("chunk_id"), F.col("node_id").cast("string")).alias("chunk_id"), F.coalesce(have("chunk_index"), F.lit(NO_INDEX)).alias("chunk_index"), F.bround("score", 6).alias("score"), snippet.alias("snippet"),
        content_type.alias("content_type"), F.coalesce(F.nullif("kind", F.lit("")), content_type).alias("kind"), *[have(c, k).alias(c) for c, k in OPTIONAL.items()], "n",
    )


def contexts(cited: DataFrame) -> DataFrame:
    """(q, context, source_ids): one block per source, in order, between blank lines."""
    told = lambda name, missing: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(missing))
    fields = {
        "filename": F.col("filename"), "content_type": F.col("content_type"), "chunk_kind": told("kind", UNKNOWN), "table_id": told("table_id", NOT_APPLICABLE), "parent_id": told("parent_id", NOT_APPLICABLE),
        "doc_id": F.col("doc"), "chunk_id": F.col("chunk_id"), "chunk_index": F.col("chunk_index"), "page_label": told("page_label", UNKNOWN), "section_title": told("section_title", UNKNOWN),
    }
    lines = [F.concat(F.lit("["), F.col("source_id"), F.lit("]")), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()), F.lit("content:"), F.col("snippet")]
    block = F.concat_ws("\n", *lines)
    return cited.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b"), "source_id"))).alias("all")).select("q", F.array_join(F.transform("all", lambda x: x["b"]), "\n\n").alias("context"), F.transform("all", lambda x: x["source_id"]).alias("source_ids"))


def enforce_citations(answers: DataFrame) -> DataFrame:
    """Adds `answer` and `outcome` to (first, second, source_ids): an answer is taken if its citations are valid or it says that its sources
    don't suffice; else the second try, else the refusal."""
    good = lambda a: C.citations_valid(C.citations(a), F.col("source_ids")) | C.insufficient(a)
    one, two = good(F.col("first")), good(F.col("second"))
    return answers.withColumn("answer", F.when(one, F.col("first")).when(two, F.col("second")).otherwise(REFUSAL)).withColumn("outcome", F.when(one, "first").when(two, "retry").otherwise("refused"))


def extractive(context: DataFrame) -> DataFrame:
    """The offline default of the answering model: the first source's text with its label."""
    first = F.regexp_extract("context", r"(?s)content:\n([^\n]*)", 1)
    return context.withColumn("first", F.concat(first, F.lit(" [S1]"))).withColumn("second", F.col("first"))


def answer(context: DataFrame, complete: Callable[[DataFrame], DataFrame] = extractive) -> DataFrame:
    return enforce_citations(complete(context))


def eval_summary(cases: DataFrame) -> DataFrame:
    """Means over all cases (ok, cited, valid, overlap); failed ones count as 0."""
    share = lambda c: F.coalesce(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"{c}_rate")
    return cases.agg(F.count("*").alias("cases"), share("ok"), share("cited"), share("valid"), F.coalesce(F.avg(F.coalesce("overlap", F.lit(0.0))), F.lit(0.0)).alias("mean_overlap"))


#: What is said where no source is asked for or found.
CLARIFY, CHAT, NOTHING = "Which documents is the question about?", "Hello! Ask me about the documents.", "No document fits the question. Please ask in other words."
#: Words below which the offline router asks back, and above which it takes a question for a request to sum up.
FEW_WORDS, MANY_WORDS = 20, 45


def rule_reply(text: Column) -> Column:
    """The offline default of the router: a reply in its JSON form, by rules. Few words are ambiguous, a text with other than ASCII letters is chat in another
    language than the index's, many words are to be summed up, the rest is a search."""
    n = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    intention = F.when(n < FEW_WORDS, "AMBIGUOUS").when(text.rlike(r"[^\x00-\x7f]"), "CHIT_CHAT").when(n > MANY_WORDS, "SUMMARIZATION").otherwise("SEARCH")
    asking = F.when(intention == "AMBIGUOUS", CLARIFY)
    return F.to_json(F.struct(intention.alias("intention"), text.alias("rewritten_query"), asking.alias("clarification_question")))


def respond(asked: DataFrame, sources_of: Callable[[DataFrame], DataFrame], complete: Callable[[DataFrame], DataFrame] = extractive, chat: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(q, text, route, response, source_ids, blob) for each of asked (q, text, reply), all routes: a question back, chat without sources, and for what is
    searched the checked answer from sources_of(routed)'s rows (as sources() gives them), or word that nothing was found. blob: the sources' texts."""
    read = asked.withColumn("_r", C.router_reply(F.col("reply"), F.col("text")))
    routed = read.select("q", "text", C.action(F.col("_r.intention"), F.col("_r.clarification_question")).alias("route"), F.col("_r.clarification_question").alias("back"), C.guarded_query(F.col("_r.rewritten_query"), F.col("text")).alias("query"))
    cited = sources_of(routed.where("route = 'retrieve'").select("q", F.col("query").alias("text")))
    blobs = cited.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda s: s["snippet"]), " ").alias("blob"))
    answered = answer(contexts(cited), complete).select("q", "answer", "source_ids")
    talk = routed.where("route = 'chat'")
    said = (chat(talk) if chat else talk.withColumn("said", F.lit(CHAT))).select("q", "said")
    both = routed.join(answered, "q", "left").join(blobs, "q", "left").join(said, "q", "left")
    response = F.when(F.col("route") == "clarify", F.coalesce("back", F.lit(CLARIFY))).when(F.col("route") == "chat", F.col("said")).otherwise(F.coalesce("answer", F.lit(NOTHING)))
    return both.select("q", "text", "route", response.alias("response"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), F.coalesce("blob", F.lit("")).alias("blob"))


def case_rows(responses: DataFrame) -> DataFrame:
    """One row per case of respond()'s rows: what the evaluation reports of it. A blank question fails."""
    cited = C.citations(F.col("response"))
    ok = strip(F.coalesce("text", F.lit(""))) != ""
    when = lambda value, missing: F.when(ok, value).otherwise(F.lit(missing))
    return responses.select(
        F.col("q").alias("case_id"), "route", ok.alias("ok"), when(F.length("response"), 0).cast("long").alias("answer_chars"), when(F.size("source_ids"), 0).cast("long").alias("source_count"), when(F.array_join(cited, ","), "").alias("cited_ids"),
        when(F.size(cited) > 0, False).alias("cited"), when(C.citations_valid(cited, F.col("source_ids")), False).alias("valid"), when(C.grounding(F.col("response"), F.col("blob")), 0.0).alias("overlap"),
    )


def route(asked: DataFrame) -> DataFrame:
    """(q, action, query) of (q, text, reply): what the router's reply, made outside, says to do with a question, and what to search for."""
    read = asked.withColumn("_r", C.router_reply(F.col("reply"), F.col("text")))
    return read.select("q", C.action(F.col("_r.intention"), F.col("_r.clarification_question")).alias("action"), C.guarded_query(F.col("_r.rewritten_query"), F.col("text")).alias("query"))
