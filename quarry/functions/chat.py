"""Predicates and extractors for chat and answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip

#: Phrases by which an answer says that its sources don't suffice.
INSUFFICIENT = [
    "don't have enough information", "do not have enough information", "insufficient evidence", "not enough information", "tidak memiliki informasi",
    "tidak cukup informasi", "tidak ada informasi", "maaf", "kurang informasi",
]
#: Rewritten queries too general to search with, and the router's intentions.
GENERIC = ["summary", "summarize", "conclusion", "ringkasan", "kesimpulan", "rangkuman"]
INTENTIONS = ["SEARCH", "SUMMARIZATION", "CHIT_CHAT", "AMBIGUOUS"]
RETRYABLE = [429, 500, 502, 503, 504]


def insufficient(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for phrase in INSUFFICIENT:
        out = out | F.contains(low, F.lit(phrase))
    return out


def citations(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(S\d+)\]"), F.lit(1))))


def citations_valid(found: Column, sources: Column) -> Column:
    return (F.size(found) > 0) & (F.size(sources) > 0) & (F.size(F.array_except(found, sources)) == 0)


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    text = strip(F.coalesce(reply, F.lit("")))
    return F.when(text.startswith("```"), strip(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"```\z", ""))).otherwise(text)


def router_prompt(history: Column, query: Column) -> Column:
    """The router's user message; history: array<struct<role,content>> of the messages before the query."""
    spoken = F.filter(history, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
    lines = F.array_join(F.transform(spoken, lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), m["content"])), "\n")
    ask = F.concat(F.lit("Pertanyaan Terbaru: "), query)
    return F.when(lines == "", ask).otherwise(F.concat(F.lit("Riwayat Obrolan:\n"), lines, F.lit("\n\n"), ask))


def messages(rows: DataFrame, most: int = 0) -> DataFrame:
    """(conv_id, messages array<struct<turn,role,content>>) of (conv_id, turn, role, text): known roles and texts that aren't blank, the last `most` (0: all)."""
    tidy = rows.select("conv_id", "turn", F.lower(strip(F.col("role"))).alias("role"), strip(F.col("text")).alias("content")).where(F.col("role").isin("system", "user", "assistant") & (F.col("content") != ""))
    if most > 0:
        tidy = tidy.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("content")))).where(F.col("_back") <= most)
    return tidy.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


def completion_text(payload: Column) -> Column:
    """The first choice's content of a completion in JSON: a string, or the texts of a list of blocks; null if there is none."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    blocks = F.from_json(content, "array<struct<text:string>>", {"mode": "PERMISSIVE"})
    texts = F.filter(F.transform(blocks, lambda b: strip(F.coalesce(b["text"], F.lit("")))), lambda x: x != "")
    return F.nullif(F.when(content.startswith("[") & blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(strip(content)), F.lit(""))


def router_reply(reply: Column, query: Column) -> Column:
    """The struct of a router's JSON reply, fenced or not; whatever can't be read is a search for the query."""
    parsed = F.from_json(unfenced(reply), "intention string, rewritten_query string, reasoning string, clarification_question string")
    good = F.upper(parsed["intention"]).isin(INTENTIONS)
    return F.struct(F.when(good, F.upper(parsed["intention"])).otherwise("SEARCH").alias("intention"), F.when(good, F.coalesce(parsed["rewritten_query"], query)).otherwise(query).alias("rewritten_query"), F.when(good, parsed["clarification_question"]).alias("clarification_question"))


def action(intention: Column, clarification: Column) -> Column:
    return F.when((intention == "AMBIGUOUS") | (F.length(F.coalesce(clarification, F.lit(""))) > 5), "clarify").when(intention == "CHIT_CHAT", "chat").otherwise("retrieve")


def guarded_query(rewritten: Column, query: Column) -> Column:
    return F.when(F.lower(strip(rewritten)).isin(GENERIC), query).otherwise(rewritten)


def grounding(answer: Column, blob: Column) -> Column:
    """The share of an answer's distinct terms that stand in the sources, also within longer words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(r"[a-z0-9]{3,}"), F.lit(0)))
    low = F.lower(blob)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(0.0)


def http_class(status: Column) -> Column:
    return F.when(status.isNull() | status.isin(RETRYABLE), "retryable").when(status.between(200, 299), "ok").otherwise("failed")


#: Prompts of this repository's own wording; {question} and {context} are filled in.
PROMPTS = {
    "chit_chat": "You help people with a collection of documents. Answer kindly and in short, in Bahasa Indonesia, without technical terms.\nUser: {question}\nAssistant:",
    "no_results": "Nothing in the documents fits the question below. Say so in Bahasa Indonesia, in one or two sentences, and suggest another question.\nQuestion: {question}",
    "grounded": "Answer from the sources alone and cite each statement as [S1]. If they don\'t suffice, say so.\nQuestion: {question}\n\nSources:\n{context}\n\nAnswer:",
    "citation_retry": "The answer had no valid citations. Answer again; every statement needs the id of a source given here.\nQuestion: {question}\n\nSources:\n{context}\n\nAnswer:",
    "standalone": "Rewrite the last question so that it can be understood without the conversation.\nConversation:\n{context}\n\nLast question: {question}",
    "rewrite": "Rewrite the question as a short search query. Give the query alone.\nQuestion: {question}",
    "summary": "Summarise the document below in at most six bullet points.\n{context}",
}


def prompt(kind: str, question: Column, context: Column) -> Column:
    return F.replace(F.replace(F.lit(PROMPTS[kind]), F.lit("{context}"), context), F.lit("{question}"), question)


def request_error(role: Column, content: Column, max_points: Column) -> Column:
    """What makes a request invalid: an unknown role, blank content, a scan of fewer than 1 or more than 100000 points; null if nothing does."""
    known = F.coalesce(role, F.lit("")).isin("system", "user", "assistant")
    return F.when(~known, "role").when(strip(F.coalesce(content, F.lit(""))) == "", "content").when(~max_points.between(1, 100_000), "max_points")
