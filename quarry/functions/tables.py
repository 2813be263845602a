"""Markdown tables as column expressions: rows, profile, visual score, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, strip

#: Patterns of headers and keywords.
LANES = r"(?i)(pelaksana|admin|pimpinan|civitas|upt|mutu|waktu|output)"
TIMES = r"(waktu|durasi|lama|time)"
CHART_WORDS = r"(flow|flowchart|workflow|decision|diagram|diagram alir|chart|arrow|connector|handoff|swimlane|panah)"
STRONG_WORDS = r"(?i)(flow\s*chart|workflow|diagram\s*alir|decision|panah|arrow|connector|swimlane)"
#: Names of the mode in which every table is interpreted.
ALWAYS_ON = ["always", "always_on", "all"]
#: The heading of interpretations and the texts of their prompt.
HEADING = "### Table Visual Interpretation"
VISUAL_PROMPT = "Describe visual process flow semantics not captured in table text."
PROMPT_CONTEXT = "Use this table markdown as context and focus on missing visual flow details:"


def split_row(line: Column) -> Column:
    """The cells of a table row; edge pipes, also several, are no cells. A line without both edge pipes has none."""
    cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)
    return F.when(line.startswith("|") & line.endswith("|"), cells).otherwise(F.array().cast("array<string>"))


def rows(content: Column) -> Column:
    """array<array<string>>: the header and body rows, without separators."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), strip)
    table = F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & ~is_separator(x))
    return F.transform(table, split_row)


def profile(content: Column, caption: Column, span_ratio: Column | None = None) -> Column:
    """struct of rows, columns, ratios to four places and the signals."""
    all_rows = rows(content)
    header = F.coalesce(F.get(all_rows, F.lit(0)), F.array().cast("array<string>"))
    body = F.slice(all_rows, 2, 1_000_000)
    n, wide = F.size(body), F.greatest(F.coalesce(F.array_max(F.transform(all_rows, F.size)), F.lit(0)), F.lit(0))
    full = F.aggregate(body, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c != "")))
    empty = F.when(n * wide > 0, 1 - full / (n * wide)).otherwise(0.0)
    span = F.coalesce(span_ratio, F.lit(0.0)) if span_ratio is not None else F.lit(0.0)
    text = F.concat(F.coalesce(caption, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    lane = F.exists(header, lambda c: c.rlike(LANES))
    keyword, strong = F.lower(text).rlike(CHART_WORDS), text.rlike(STRONG_WORDS)
    flow = lane & (wide >= 6) & (empty >= 0.50) & ((span >= 0.05) | (n >= 8))
    return F.struct(
        n.alias("num_rows"), wide.alias("num_cols"), F.bround(empty, 4).alias("empty_ratio"), F.bround(span, 4).alias("span_ratio"),
        lane.alias("lane"), keyword.alias("keyword"), strong.alias("strong"), (keyword | strong | flow).alias("chart"),
    )


def visual_score(p: Column) -> Column:
    """struct<score,reasons,strong> of a profile."""
    empty, cols, n, span = p["empty_ratio"], p["num_cols"], p["num_rows"], p["span_ratio"]
    flow = p["lane"] & (cols >= 6) & (empty >= 0.50) & ((span >= 0.05) | (n >= 8))
    rules = [
        (p["strong"], 0.85, "strong_visual_keyword"), (p["lane"], 0.15, "lane_headers"), (empty >= 0.60, 0.22, "high_empty_cell_ratio"),
        ((empty >= 0.48) & (empty < 0.60), 0.14, "moderate_empty_cell_ratio"), (cols >= 7, 0.08, "wide_table"), (n >= 8, 0.06, "long_table"),
        (span >= 0.08, 0.12, "merged_cells"),
    ]
    total = sum((F.when(c, F.lit(x)).otherwise(0.0) for c, x, _ in rules), F.lit(0.0))
    score = F.least(F.lit(1.0), F.when(flow, F.greatest(total, F.lit(0.82))).otherwise(total))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, _, name in [*rules, (flow, 0, "structural_flow_pattern")]]))
    return F.struct(score.alias("score"), reasons.alias("reasons"), (p["strong"] | flow).alias("strong"))


def visual_selected(scored: Column, threshold: float = 0.75, require_strong: bool = True, always: bool = False) -> Column:
    return F.lit(True) if always else (scored["score"] >= threshold) & (F.lit(not require_strong) | scored["strong"])


def routing_mode(raw: Column) -> Column:
    """always_on for its three names, else auto_signal."""
    return F.when(F.lower(strip(F.coalesce(raw, F.lit("")))).isin(ALWAYS_ON), "always_on").otherwise("auto_signal")


def signal_threshold(setting: Column, bias: Column) -> Column:
    """The setting within [0, 1]; where it can't be read, what the bias stands for."""
    name = F.lower(strip(F.coalesce(bias, F.lit(""))))
    fallback = F.when(name == "balanced", 0.65).when(name == "recall", 0.55).otherwise(0.75)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(strip(setting).try_cast("double"), fallback)))


def visual_bullets(content: Column) -> Column:
    """The bullets from the first one behind the interpretation's heading to the next blank line, without their marks."""
    lines = F.transform(F.split(F.regexp_extract(content, r"(?s)### Table Visual Interpretation(.*)$", 1), "\n"), strip)
    bullet = lambda x: x.rlike(r"^(-|\d+\.\s)")
    first = F.array_position(F.transform(lines, bullet), F.lit(True)).cast("int")
    rest = F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))
    blank = F.array_position(rest, F.lit("")).cast("int")
    block = F.when(blank > 0, F.slice(rest, 1, F.greatest(blank - 1, F.lit(0)))).otherwise(rest)
    texts = F.transform(F.filter(block, bullet), lambda x: strip(F.regexp_replace(x, r"^[-0-9. ]+", "")))
    return F.when(first > 0, F.filter(texts, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def anchor_texts(all_rows: Column, content: Column, caption: Column, most: int = 6) -> Column:
    """Short texts that stand for a table, distinct without regard to case, at most `most`. all_rows: a column that holds rows(content), so that
    each of its many uses doesn't parse the table again."""
    header = F.coalesce(F.get(all_rows, F.lit(0)), F.array().cast("array<string>"))
    body = F.slice(all_rows, 2, 1_000_000)

    def column(k: Column) -> Column:
        return F.filter(F.transform(body, lambda r: F.coalesce(F.get(r, k), F.lit(""))), lambda x: x != "")

    def first(pattern: str) -> Column:
        return F.array_position(F.transform(header, lambda c: F.lower(c).rlike(pattern)), F.lit(True)).cast("int") - 1

    def line(label: str, values: Column, sep: str, n: int) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.slice(values, 1, n), sep)))

    none = F.array().cast("array<string>")
    time_at, out_at = first(TIMES), first("output")
    lines = F.array(
        F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Table caption: "), caption)), line("Table headers: ", header, ", ", 12),
        line("Roles and lanes: ", F.filter(header, lambda c: c.rlike(LANES)), ", ", 10), line("Main activities: ", column(F.lit(1)), " | ", 8),
        line("Timing constraints: ", F.when(time_at >= 0, column(time_at)).otherwise(none), ", ", 10),
        line("Expected outputs: ", F.when(out_at >= 0, column(out_at)).otherwise(none), ", ", 10), line("Visual flow cues: ", visual_bullets(content), " | ", 4),
    )
    return F.slice(distinct_lines(lines), 1, most)


def distinct_lines(lines: Column) -> Column:
    """Lines with single blanks, the first of those that are equal without regard to case; blank ones go."""
    tidy = F.filter(F.transform(F.array_compact(lines), collapse), lambda x: x != "")
    return F.aggregate(tidy, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))))


def is_separator(line: Column) -> Column:
    return strip(line).rlike(r"^\|[\s:|-]+\|$")


def chart_signals(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(CHART_WORDS)


def _append(content: Column, block: Column) -> Column:
    return F.when(F.contains(content, block), content).otherwise(F.concat(F.regexp_replace(content, r"(?U)\s+\z", ""), F.lit("\n\n"), block, F.lit("\n")))


def append_interpretation(content: Column, interpretation: Column) -> Column:
    """Idempotent: a block that stands in the content already is not added again."""
    text = strip(F.coalesce(interpretation, F.lit("")))
    block = F.concat(F.lit(f"{HEADING}\n"), F.when(text.rlike(r"^([-*]|\d+\.)\s"), text).otherwise(F.concat(F.lit("- "), text)))
    return F.when(text == "", content).otherwise(_append(content, block))


def append_pending(content: Column, attempts: Column, error: Column) -> Column:
    """Marks a table whose interpretation is to be tried again; idempotent."""
    detail = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit(" Last error: "), F.substring(error, 1, 280))).otherwise("")
    return _append(content, F.concat(F.lit(f"{HEADING}\n- Pending visual interpretation retry after "), attempts, F.lit(" attempt(s)."), detail))


def visual_prompt(content: Column, base: str = VISUAL_PROMPT) -> Column:
    excerpt = F.substring(strip(F.coalesce(content, F.lit(""))), 1, 2500)
    return F.concat(F.lit(f"{base}\n\n{PROMPT_CONTEXT}\n```markdown\n"), excerpt, F.lit("\n```"))


def retried(outcomes: Column, enabled: bool = True, most: int = 5) -> Column:
    """struct<status, attempts> of tries in order (ok, retryable or failed): they end at the first that is not retryable or at the last one allowed."""
    tries = F.slice(outcomes, 1, most if enabled else 1)
    end = F.array_position(F.transform(tries, lambda x: x != "retryable"), F.lit(True)).cast("int")
    used = F.when(end > 0, end).otherwise(F.size(tries))
    status = F.when(F.element_at(F.slice(tries, 1, used), -1) == "ok", "done").when(F.lit(enabled) & F.array_contains(F.slice(tries, 1, used), "retryable"), "pending").otherwise("failed")
    return F.struct(status.alias("status"), used.alias("attempts"))


def retry_queue(entries: DataFrame) -> DataFrame:
    """The entries (status, image_path) that are to be tried again: pending ones whose picture was kept."""
    return entries.where((F.col("status") == "pending") & (F.coalesce("image_path", F.lit("")) != ""))
