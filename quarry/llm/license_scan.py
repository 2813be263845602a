"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates licence expressions.

Expressions stand behind tags ("MIT OR Apache-2.0"; of what follows a tag the longest whole expression counts) and in prose (notice phrases with `or`,
`and` or `with` between them). A text is permissive if each of its expressions leaves a choice that is.

Null texts count as empty: no words, no labels, score 0. Very long texts are scanned whole, in time in proportion to their length. Repeated rows each
get their own result; phrases that overlap or end at the same word all count, and of tags all do. Columns of the input other than the id and
the text are ignored, so clashing names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payload

#: Phrase -> label; every word of a phrase must stand consecutively.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: The method's own notice phrases.
OWN_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "cc by sa": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
TAG_PHRASE = "spdx license identifier"
#: Beginning of a lower-case licence identifier, up to its end, a sign or a version -> label; the first that fits counts.
IDENTIFIER_LABELS = {
    "mit": "mit", "apache-2": "apache-2", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc0": "public-domain", "unlicense": "public-domain",
    "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mpl": "mpl", "bsd": "bsd",
}
#: Licence identifiers of letters alone; other words of letters are prose, not identifiers.
PLAIN_IDENTIFIERS = set(
    """aal abstyles adsl afmparse aladdin ampas apafml barr beerware borceux caldera condor crossword crystalstacker cube curl diffmark dotseqn dsdp dvipdfm egenix entessa eudatagrid eurosym
    fsful ftl giftware glide glulxe gnuplot haskellreport hpnd imatix imlib intel ipa isc jasper json leptonica libpng libtiff miros motosoto mtll multics mup naumen ncsa newsletr nlpl nokia
    nosl noweb nrl ntp oclc ogtsl oml openssl postgresql psfrag psutils qhull rdisc rscpl ruby saxpath scea sendmail sissl sleepycat smlnj snia swl tcl tmate tosl upl vim vostrom w3c wsuipa
    wtfpl xerox xnet xpp xskat zed zlib""".split()
)
#: Words that may stand between an operator and the notice phrase behind it.
FILLERS = {"the", "under", "of", "terms"}
#: Labels that permit reuse without further conditions on other works.
PERMISSIVE = {"mit", "apache-2", "bsd", "public-domain"}
EVIDENCE = {"tag": 0.95, "phrase": 0.8}

#: A-Z to a-z; every other ASCII byte that isn't a digit or small letter to a blank; bytes of other characters stay.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def identifier_label(identifier: str) -> str:
    """The label of a known licence, else the identifier itself; raises ValueError for a word that is no identifier."""
    low = identifier.lower()
    for prefix, label in IDENTIFIER_LABELS.items():
        if low.startswith(prefix) and re.match(r"v?\d|[^a-z]|$", low[len(prefix) :]):
            return label
    if low.isalpha() and low not in PLAIN_IDENTIFIERS or not any(map(str.isalpha, low)):
        raise ValueError(f"{identifier!r} is no licence identifier")
    return low.rstrip("+")


def longest_prefix(tokens: list[str]) -> tuple[list[str], int]:
    """Shunting-yard over tokens: with binds tighter than and, and tighter than or; a slash is an or. (postfix form, tokens read) of the longest prefix
    that is a whole expression of identifiers; prose, a parenthesis too many or an operator without its operand end it. ([], 0) if there is none."""
    out: list[str] = []
    stack: list[str] = []
    best: tuple[list[str], int] = [], 0
    operand_next = True
    for k, token in enumerate(tokens, 1):
        low = "or" if token == "/" else token.lower()
        if token == "(" or low not in _RANK and token != ")":
            if not operand_next:
                break
            if token == "(":
                stack.append(token)
                continue
            try:
                identifier_label(token)
            except ValueError:
                break
            out.append(token)
            operand_next = False
        elif operand_next:
            break
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        if not operand_next and "(" not in stack:
            best = out + stack[::-1], k
    return best


def to_postfix(expression: str) -> list[str]:
    """The postfix form of an expression, up to prose behind it. Raises ValueError where the expression is not well formed."""
    tokens = _TOKEN.findall(expression)
    postfix, n = longest_prefix(tokens)
    if not n or n < len(tokens) and (tokens[n] in "()" or tokens[n].lower() in _RANK):
        raise ValueError("not well formed")
    return postfix


def _value(postfix: list[str]) -> tuple[set[str], bool]:
    values: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            (b, fb), (a, fa) = values.pop(), values.pop()
            values.append((a, fa) if token == "with" else (a | b, fa or fb if token == "or" else fa and fb))
        else:
            label = identifier_label(token)
            values.append(({label}, label in PERMISSIVE))
    return values[0]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of the expression, and whether some choice that it leaves is permissive: or needs one side, and both; an exception never forbids."""
    return _value(to_postfix(expression))


def _phrase_expressions(found: list[tuple[int, int, str]], flat: str) -> list[list[str]]:
    """Notice phrases (begin, end, label) in order of their ends, as expressions: an `or`, `and` or `with` between two of them joins them."""
    out: list[list[str]] = []
    last = 0
    for begin, end, label in found:
        between = [w for w in flat[last:begin].split() if w not in FILLERS] if begin - last < 60 else []
        if out and begin >= last and len(between) == 1 and between[0] in _RANK:
            out[-1] += [between[0], label]
        else:
            out.append([label])
        last = end
    return out


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("own", OWN_PHRASES), ("tag", {TAG_PHRASE: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


def scan(text: bytes, matcher: ahocorasick.Automaton) -> tuple:
    """One text: its words stand between single blanks, so that phrases with a blank on each side match whole words only."""
    words = text.translate(_FOLD).split()
    flat = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, base_labels, labels, evidence, tagged, phrases = [], set(), set(), 0.0, False, []
    at = word = 0  # the word that begins behind the blank at `at`
    for end, (kind, label, back) in matcher.iter(flat):
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        phrases.append((end - back, end, label))
        evidence = 1 - (1 - evidence) * (1 - EVIDENCE["phrase"])
        if kind == "base":
            start = end - back
            word += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            base.append(word)
            base_labels.add(label)
    permissive = all(_value(longest_prefix(e)[0])[1] for e in _phrase_expressions(phrases, flat)) if labels else None
    if tagged:
        for expression in _TAG.findall(text.decode("utf-8", "replace")):
            postfix, n = longest_prefix(_TOKEN.findall(expression))
            if not n:
                continue
            found, free = _value(postfix)
            labels |= {x.replace(",", "") for x in found}
            permissive = free and permissive is not False
            evidence = 1 - (1 - evidence) * (1 - EVIDENCE["tag"])
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(evidence, 1.0), permissive


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = automaton()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
    names = SCHEMA.split()[::2]
    for batch in batches:
        rows = [scan(x.as_py(), matcher) for x in batch.column(1)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs (SCHEMA): no shuffle, one pass over the texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), payload(text_col).alias("text")).mapInArrow(_scan_batches, SCHEMA)
