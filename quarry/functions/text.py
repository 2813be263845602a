"""Text functions as column expressions. Patterns are Unicode-aware; NFKC, which Spark lacks, is the one Arrow UDF."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that a rewritten query leaves out.
STOPWORDS = "a an and are as at be by for from how in is it of on or the to what when where which who why".split()
#: The beginnings of markdown lines, the forms of page markers, the characters that count as blanks.
MARKDOWN = r"^(#{1,6}\s|[-*+]\s|\d+\.\s|>\s|\|)"
PAGE_MARKER = r"^(page\s*\d+(\s*(of|/)\s*\d+)?|\d+\s*(of|/)\s*\d+|\d{1,4})$"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Fixed value: the pattern of clauses.
CLAUSE = r"[^,.;。？！]+[,.;。？！]?"
#: What ends a paragraph, a sentence and a word; each is found in one pass, whatever the text.
_ENDS = {"paragraph": re.compile(r"\n\n+"), "sentence": re.compile(r"[.!?。？！]\s+"), "word": re.compile(r"\s+")}
_CLAUSES = re.compile(rf"{CLAUSE}|[,.;。？！]+", re.S)
#: A token, where no tokenizer is given: a character of a script without blanks, or at most 16 other characters of a word.
_WIDE = "\u2e80-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_TOKEN = re.compile(rf"[{_WIDE}]|[^\s{_WIDE}]{{1,16}}")
#: Bytes as they are if a word of letters and digits can have them, else as a blank.
_APART = bytes(c if chr(c) in string.ascii_lowercase + string.digits else 0x20 for c in range(256))


def word_bytes(text: str) -> list[bytes]:
    """The runs of a-z and 0-9 of a text in lower case, those of one character too, in order: what the pattern [a-z0-9]+ finds, in about half its time."""
    return text.lower().encode().translate(_APART).split()


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_query(query: Column) -> Column:
    """NFKC, single blanks, none at the ends."""
    return collapse(nfkc(F.coalesce(query, F.lit(""))))


def is_markdown(line: Column) -> Column:
    return line.rlike(MARKDOWN)


def is_page_marker(line: Column) -> Column:
    return F.lower(strip(line)).rlike(PAGE_MARKER)


def trim_text(text: Column, most: int) -> Column:
    """Texts over `most` characters end at their last blank before it, with three dots."""
    cut = strip(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", ""))
    return F.when(F.length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def short_line(line: Column) -> Column:
    """At most 80 characters and 12 words, and no markdown. Words are counted by a pattern: splitting compiles its pattern anew for each line."""
    return (line != "") & (F.length(line) <= 80) & ~line.rlike(r"(?U)^(?:\S++\s++){12}\S") & ~is_markdown(line)


def frequent_lines(lines: Column) -> Column:
    """Short lines, in lower case, that make up a share of 0.04 and at least 4 of all lines, blanks included: in sorted order a line that
    occurs m times equals the one m - 1 places on."""
    keys = F.array_sort(F.transform(F.filter(F.transform(lines, strip), short_line), F.lower))
    least = F.greatest(F.lit(4), F.ceil(F.round(F.size(lines) * 0.04, 9)).cast("int"))
    return F.array_distinct(F.array_compact(F.zip_with(keys, F.slice(keys, least, F.greatest(F.size(keys), F.lit(1))), lambda x, y: F.when(x == y, x))))


def drop_boilerplate(docs: DataFrame, lines_col: str, keep_markers: bool = False) -> DataFrame:
    """docs whose array of lines has no page markers and no frequent short lines; blanks and table rows stay. The frequent lines are a generated
    column, made once a document."""
    marked = docs.withColumn("_often", F.explode(F.array(frequent_lines(F.col(lines_col)))))
    pairs = F.transform(lines_col, lambda x: F.struct(x.alias("x"), strip(x).alias("s")))  # each line is stripped once
    frequent = lambda s: (F.size("_often") > 0) & (F.length(s) <= 80) & F.array_contains("_often", F.lower(s)) & short_line(s)
    marker = lambda s: F.lit(False) if keep_markers else s.rlike("^[Pp0-9]") & F.lower(s).rlike(PAGE_MARKER)
    kept = F.filter(pairs, lambda p: (p["s"] == "") | p["s"].startswith("|") | ~(marker(p["s"]) | frequent(p["s"])))
    return marked.withColumn(lines_col, F.transform(kept, lambda p: p["x"])).drop("_often")


def normalize_markdown(docs: DataFrame, text_col: str = "text", out: str = "normalized", keep_markers: bool = False) -> DataFrame:
    """docs with the normalised text: NFKC, line ends, soft and end-of-line hyphens, boilerplate, blanks. The composed form and the lines are
    columns of their own, since lambdas can't hold a Python function."""
    composed = docs.withColumn("_nfkc", nfkc(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_nfkc", F.explode(F.array("_nfkc")))
    t = F.regexp_replace("_nfkc", r"\r\n?", "\n")
    t = F.regexp_replace(F.replace(t, F.lit("\u00ad"), F.lit("")), r"(?U)(?<=\w)-\n(?=\w)", "")
    lines = drop_boilerplate(composed.withColumn("_lines", F.explode(F.array(F.split(t, "\n")))), "_lines", keep_markers)
    tidy = F.transform("_lines", lambda x: F.regexp_replace(F.when(strip(x).startswith("|"), x).otherwise(F.regexp_replace(x, r"[ \t]{2,}", " ")), r"(?U)\s+\z", ""))
    return lines.withColumn(out, strip(F.regexp_replace(F.array_join(tidy, "\n"), r"\n{3,}", "\n\n"))).drop("_nfkc", "_lines")


def terms(query: Column, most: int = 12) -> Column:
    """Distinct words without stopwords in their order (all words if nothing else is left), at most `most`."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(found)), 1, most)


def rewrite(query: Column, most: int = 12) -> Column:
    words = terms(query, most)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(query)


def variants(query: Column, weight: float = 0.6, enabled: bool = True) -> Column:
    """array<struct<query,weight>>: the rewritten query and the plain one, one of them where they are equal, none for a blank query; not enabled, only
    the plain one. query: as normalize_query() gives it, a column of its own, since lambdas can't hold a Python function; reranking takes the original."""
    plain = collapse(query)
    short = rewrite(plain) if enabled else plain
    pair = lambda q, w: F.struct(q.alias("query"), F.lit(w).alias("weight"))
    w = min(1.0, max(0.0, weight))
    return F.when(plain == "", F.slice(F.array(pair(plain, 1.0)), 1, 0)).when(short == plain, F.array(pair(plain, 1.0))).otherwise(F.array(pair(short, w), pair(plain, 1.0 - w)))


def fallback_summary(text: Column) -> Column:
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, 6)
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), F.substring(x, 1, 180))), "\n")).otherwise("Summary unavailable.")


def page_label(value: Column) -> Column:
    low = F.lower(strip(value))
    number = F.coalesce(F.nullif(F.regexp_extract(low, r"^page\s*(\d+)(?:\s*(?:of|/)\s*\d+)?$", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"^(\d+)\s*(?:of|/)\s*\d+$", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"^(\d{1,4})$", 1), F.lit("")))
    n = number.try_cast("int")
    return F.when(n.between(1, 5000), F.concat(F.lit("Page "), n))


def plain_tokens(text: str) -> list[int]:
    """Where tokens of a text end, by the rule for texts without a tokenizer."""
    return [m.end() for m in _TOKEN.finditer(text)]


def subwords(content: str):
    """Where tokens of a text end, by a tokenizer's JSON file (its content; vocabularies are public ones, none is trained here)."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content)
    return lambda text: [end for _, end in made.encode(text, add_special_tokens=False).offsets]


def _cut(text: str, level: str) -> list[str]:
    if level == "clause":
        return _CLAUSES.findall(text)
    ends = [m.end() for m in _ENDS[level].finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a]


def _units(text: str, tokens: int, ends=plain_tokens) -> list[tuple[str, int]]:
    """(piece, tokens): paragraphs, where too large their sentences, where too large those' clauses, then words, and at last stretches of `tokens`
    tokens; joined, they are the text."""
    levels = ["paragraph", "sentence", "clause", "word"]
    out: list[tuple[str, int]] = []
    todo = [(text, 0)]
    while todo:
        piece, level = todo.pop()
        found = ends(piece)
        if len(found) <= tokens:
            if piece:
                out.append((piece, len(found)))
        elif level < len(levels):
            todo += [(x, level + 1) for x in reversed(_cut(piece, levels[level]))]
        else:
            # Tokens of bytes may end within a character: such a stretch ends with the character.
            cuts = sorted({found[k] for k in range(tokens - 1, len(found), tokens)} | {len(piece)})
            out += [(piece[a:b], min(tokens, len(found) - k * tokens)) for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)) if b > a]
    return out


def split_text(text: str, tokens: int, overlap: int, ends=plain_tokens) -> list[str]:
    """Chunks of at most `tokens` tokens of whole units, each begun with the last units of the one before that have at most `overlap` tokens."""
    chunks: list[list[tuple[str, int]]] = []
    held: list[tuple[str, int]] = []
    size = fresh = 0
    for unit in _units(text, tokens, ends):
        if fresh and size + unit[1] > tokens:
            chunks.append(held)
            kept, size = [], 0
            for back in reversed(held):
                if size + back[1] > min(overlap, tokens - unit[1]):
                    break
                kept.append(back)
                size += back[1]
            held, fresh = kept[::-1], 0
        held.append(unit)
        size, fresh = size + unit[1], fresh + 1
    if fresh:
        chunks.append(held)
    return [x for x in ("".join(p for p, _ in c).strip() for c in chunks) if x]


def sentence_chunks(tokens: int = 768, overlap: int = 200, tokenizer: str | None = None):
    """A column function: the chunks of a text, split_text() in Arrow batches. Tokens are counted by our own rule, or by the tokenizer whose JSON content
    is given; it is sent along with the function. A null text has none."""

    @F.pandas_udf(ArrayType(StringType()))
    def chunks(text: pd.Series) -> pd.Series:
        ends = plain_tokens if tokenizer is None else subwords(tokenizer)
        return text.map(lambda x: [] if x is None else split_text(x, tokens, overlap, ends))

    return chunks


def heading(line: Column) -> Column:
    """The title of a markdown heading, at most 200 characters; else null."""
    title = strip(F.regexp_extract(strip(line), r"^#{1,6}\s+(.+)$", 1))
    return F.nullif(F.substring(title, 1, 200), F.lit(""))


def to_bool(value: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(strip(value)).isin("1", "true", "yes", "on"), F.lit(default))


def to_int(value: Column, default: int, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.coalesce(F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), strip(value).try_cast("int")), F.lit(default)))


def to_float(value: Column, default: float, least: float, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(strip(value).try_cast("double"), F.lit(default))))
