"""URL filters: all glob rules run at once as one bit-parallel Shift-And automaton over multiword masks.

A null url, or one without ``://``, has an empty host and path, fits no rule and gets the method's verdict for an empty url (allow).
Repeated rows each get their own result; columns other than the id and the url are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule), a rule being host and path; the longest that fits decides.
BASE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The method's own globs on ``.host/path``, which decide where no rule fits; `*` stops at a slash, `**` does not. Without a fit: allow.
OWN_GLOBS = [("block", "*.spam-farm.*/**"), ("block", "*/**.exe"), ("block", "*/**/wp-login*")]
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


class ShiftAnd:
    """Bit j of a state says: the glob's elements up to j have matched. Each glob begins with a start bit; a star is a loop on the bit before it."""

    def __init__(self, globs: list[str]) -> None:
        self.globs = globs
        start, final, steps, loops, size = [], [], [], [], 0
        for glob in globs:
            start.append(size)
            data, k = glob.encode(), 0
            while k < len(data):
                if data[k] == 42:
                    anything = data[k : k + 2] == b"**"
                    loops.append((size, anything))
                    k += 1 + anything
                else:
                    size += 1
                    steps.append((size, data[k]))
                    k += 1
            final.append(size)
            size += 1
        self.words = (size + 63) // 64
        self.step, self.loop = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for bit, byte in steps:
            self.step[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, anything in loops:
            self.loop[:, bit // 64] |= np.uint64(1 << bit % 64)
            if not anything:
                self.loop[47, bit // 64] &= ~np.uint64(1 << bit % 64)
        self.start = np.zeros(self.words, np.uint64)
        for bit in start:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
        self.final = np.array(final)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (texts, globs): the globs that fit each whole text. Texts advance together, the longest first, so that the running ones stay in front."""
        lengths = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths[order])
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins, running = ends - lengths[order], len(texts)
        state = np.tile(self.start, (len(texts), 1))
        for k in range(int(lengths.max(initial=0))):
            while running and lengths[order[running - 1]] <= k:
                running -= 1
            byte, now = flat[begins[:running] + k], state[:running]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (moved & self.step[byte]) | (now & self.loop[byte])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(texts), len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def rule_glob(rule: str) -> str:
    """The glob on ``.host/path`` of a rule: its host and all subdomains, paths that start with the rule's."""
    return f"*.{rule}**"


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | None = None, globs: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages (SCHEMA): no shuffle, one pass over the urls."""
    rules, globs = rules if rules is not None else BASE_RULES, globs if globs is not None else OWN_GLOBS
    ranked = sorted(rules, key=lambda x: -len(x[1]))
    machine = ShiftAnd([*(rule_glob(r) for _, r in ranked), *(g for _, g in globs)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(x.as_py()) for x in batch.column(1)]
            hits = machine.matches([f".{h}{p}".encode() for h, p in parts])
            rule, verdict = [], []
            for row in hits:
                k = int(row[: len(ranked)].argmax()) if row[: len(ranked)].any() else -1
                own = next((v for (v, _), fits in zip(globs, row[len(ranked) :], strict=True) if fits), "allow")
                rule.append(ranked[k][1] if k >= 0 else None)
                verdict.append(ranked[k][0] if k >= 0 else own)
            columns = [[h for h, _ in parts], [p for _, p in parts], rule, verdict]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=SCHEMA.split()[::2])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(judge, SCHEMA)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, strpos(url, '://') AS pos, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN coalesce(pos, 0) = 0 THEN '' ELSE translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN coalesce(pos, 0) = 0 OR strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path, '.' || host AS dotted, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN strpos(dotted, '.spam-farm.') > 0 AND starts_with(path, '/') THEN 'block'
  WHEN starts_with(path, '/') AND ends_with(path, '.exe') THEN 'block'
  WHEN regexp_matches(path, '/wp-login[^/]*$') AND strpos(substr(path, 2), '/wp-login') > 0 THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""
