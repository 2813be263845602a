"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment. DataFrame functions only.

An item's signature holds its smallest shingle hashes, their number k from its own size n: a document that contains at least the threshold of its
shingles lacks at most n - ceil(threshold n) of them, so of the k = n - ceil(threshold n) + HITS smallest (or all n) it holds k less that many. That
share of a document's hits in a signature estimates the containment; documents with fewer hits can't reach the threshold, so none is missed.
Documents are partitioned by powers of two of their shingles; signatures stand in each partition whose documents are large enough to contain the
item (the last one holds all larger documents), and a document probes its own partition alone.

Words are runs of letters and digits, A-Z lower-cased; all characters beyond ASCII count as letters. Texts of one to four words are one
shingle; null, empty and wordless texts have none and match nothing. Very long texts are searched whole. Equal hashes of an item all count: of
equal ones none is cut off alone, since hashes are distinct in it. Repeated rows of documents give one result per id; rows of null id count as
one id, null, and each text is looked at by itself; so do items of null id. Columns other than ids and
texts are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small_or_shuffled

SHINGLE, THRESHOLD = 5, 0.8
#: Hits in a signature that a document needs, unless the item has fewer shingles to spare; the partition of all larger documents.
HITS, LAST_CLASS = 3, 20
#: Bytes up to which signatures or shingles of items, counted before, are sent to every task.
BROADCAST_BYTES = 48 << 20
_SIGNS = "".join(map(chr, [*range(0x01, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _SIGNS + "\0", _UPPER.lower() + " " * (len(_SIGNS) + 1)))
    return F.when(plain != "", F.split(plain, " +")).otherwise(F.array().cast("array<string>"))


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    """The words as a column of their own, computed once: a generator keeps them from being inlined where they are used."""
    return df.withColumn("words", F.explode(F.array(words(F.col(text_col)))))


def _shingles(make) -> Column:
    """make() of each five neighbouring words; of all words where there are fewer; an empty array where there are none."""
    w, n = F.col("words"), F.size("words")
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(make(*[F.coalesce(F.get(w, F.lit(k)), F.lit("")) for k in range(SHINGLE)]))).otherwise(F.slice(F.array(make(*[F.lit("")] * SHINGLE)), 1, 0))


def _spread_hashes(texts: DataFrame) -> DataFrame:
    """(doc_id, size_class, h): a row for each shingle of each text; words are looked up by place, so that no array of shingles is made."""
    placed = _with_words(texts, "doc_text").withColumn("n", F.size("words")).where("n > 0").select("doc_id", "words", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0)))).alias("i"))
    h = F.xxhash64(*[F.coalesce(F.get("words", F.col("i") + k), F.lit("")) for k in range(SHINGLE)])
    return placed.select("doc_id", size_class(F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))).alias("size_class"), h.alias("h"))


def size_class(n: Column) -> Column:
    return F.least(F.lit(LAST_CLASS), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double") + F.lit(1e-9))).cast("int"))


def _probe(column: str) -> Column:
    """A hash within its partition, as one long to join on."""
    return F.col("h").bitwiseXOR(F.shiftleft(F.col(column).cast("long"), 52))


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(probe, h, item_id, least_hits) for items (item_id, hashes array of distinct longs): one row per hash and partition that can hold the item."""
    n = F.size("hashes")
    need = F.ceil(F.round(n * F.lit(threshold), 9)).cast("int")
    sized = items.where(n > 0).withColumn("spare", n - need).withColumn("k", F.least(n, F.col("spare") + HITS)).withColumn("classes", F.sequence(size_class(need), F.lit(LAST_CLASS)))
    hashes = sized.select("item_id", "classes", (F.col("k") - F.col("spare")).alias("least_hits"), F.explode(F.slice(F.array_sort("hashes"), 1, F.col("k"))).alias("h"))
    return hashes.select("h", "item_id", "least_hits", F.explode("classes").alias("size_class")).select(_probe("size_class").alias("probe"), "h", "item_id", "least_hits")


def _if_small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _meet(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """left joined with right on a column in which nulls are equal."""
    met = left.join(right.withColumnRenamed(column, "_met"), F.col(column).eqNullSafe(F.col("_met")), how)
    return met.drop("_met")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for every document and item with containment >= threshold."""
    items = _with_words(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).distinct(), "item_text")
    items = materialize(items.select("item_id", F.sha2(F.coalesce("item_text", F.lit("")), 256).alias("item_key"), F.array_distinct(_shingles(F.xxhash64)).alias("hashes"), F.array_distinct(_shingles(lambda *w: F.concat_ws(" ", *w))).alias("item_shingles")), "items")
    probe = materialize(signatures(items, threshold), "signatures")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    found = _spread_hashes(texts).select("doc_id", _probe("size_class").alias("probe")).join(_if_small(probe, 40 * probe.count()), "probe")
    estimated = found.groupBy("doc_id", "item_id", "least_hits", "h").agg(F.lit(1).alias("one")).groupBy("doc_id", "item_id", "least_hits").agg(F.count("*").alias("hits"))
    pairs = materialize(estimated.where(F.col("hits") >= F.col("least_hits")).select("doc_id", "item_id").distinct(), "pairs")
    wanted = pairs.select("doc_id").distinct()
    chosen = _meet(texts, small_or_shuffled(wanted, wanted.count(), BROADCAST_ROWS), "doc_id", "left_semi")
    spread = _with_words(chosen, "doc_text").select("doc_id", F.sha2("doc_text", 256).alias("doc_key"), F.explode(F.array_distinct(_shingles(lambda *w: F.concat_ws(" ", *w)))).alias("shingle"))
    listed = items.select("item_id", "item_key", F.size("item_shingles").cast("long").alias("n_item_shingles"), F.explode("item_shingles").alias("shingle"))
    n_bytes = listed.agg(F.coalesce(F.sum(F.octet_length("shingle") + 60), F.lit(0))).first()[0]
    # Distinct shingles of a text meet those of items one by one: no row holds more than one shingle.
    shared = spread.join(_if_small(listed, n_bytes), "shingle").groupBy("doc_id", "doc_key", "item_id", "item_key", "n_item_shingles").agg(F.count("*").alias("n_shared"))
    enough = shared.where(F.col("n_shared") >= F.ceil(F.round(F.col("n_item_shingles") * F.lit(threshold), 9))).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    return enough.groupBy("doc_id", "item_id").agg(F.max("n_item_shingles").alias("n_item_shingles"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(translate(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(translate(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') || CASE WHEN len(w) < 5 THEN repeat(' ', 5 - len(w)::INT) ELSE '' END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') || CASE WHEN len(w) < 5 THEN repeat(' ', 5 - len(w)::INT) ELSE '' END AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared::DOUBLE / n AS containment
FROM hits JOIN n USING (item_id) WHERE n_shared >= ceil(round(n * 0.8::DOUBLE, 9))
"""
