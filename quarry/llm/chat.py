"""Chat formatting by event sourcing: logs are partitioned by conversation, sorted by sequence and folded into final messages, which are rendered.

Events (conv_id, seq, message, kind, role, text) carry one sequence for the whole conversation; `message` tells its messages apart. `open` starts a
message of a role, `delta` appends, `edit` replaces what stands so far, `regenerate` drops it and starts anew, `delete` removes the message; other
kinds do nothing, and a message that was never opened is dropped. Messages stand in order of the sequence at which they were last opened, at equal
ones by role, then text. Equal sequence numbers of a message are taken in order of kind and text, so repeated events apply twice.

One shuffle by conversation and one fold, which renders as it goes. Conversations of more than ``most_bytes`` of events, measured before by a
sum of lengths, are folded message by message in many tasks and rendered in pieces, in order over range partitions, so no task holds one whole.

Null texts and roles are empty; very long texts are one message, which is in no case divided. A conversation without messages gives no row. Rows of a null
conv_id are one conversation. Columns of the input other than those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_or_shuffled, task_partitions

#: The template. After escaping no text and no role holds `<` or `[`, so none can hold a control string.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3")]
DELTA_CHARS, DRAFT_CHARS = 400, 16
#: Events of one turn of a finished conversation, as a power of two.
TURN_BITS = 23
#: Bytes of events up to which a conversation is folded in one task, and characters after which a piece of a larger one ends.
MOST_BYTES, PIECE_CHARS = 64 << 20, 8 << 20
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
FORMATTED = "conv_id long, piece long, formatted string"  # and whole boolean
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Reversible: `~` and the first characters of all control strings become two-character codes."""
    for plain, coded in ESCAPES:
        text = text.replace(plain, coded)
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def to_events(rows: DataFrame) -> DataFrame:
    """An event log of finished messages (conv_id, turn, role, text), made row by row: streamed deltas; an assistant's message is first drafted and
    regenerated, others are opened with a draft that an edit replaces. Rows of one turn are messages of their own. Null turns count
    as 2^39 and so come last; a turn of 2^40 or more either way raises an error."""
    ordered = rows.select("conv_id", F.coalesce("turn", F.lit(1 << 39)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / DELTA_CHARS)).cast("int")),
        lambda k: F.substring(F.col("text"), k * DELTA_CHARS + 1, F.lit(DELTA_CHARS)),
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.array(event("open", F.lit("")), event("delta", F.substring("text", 1, DRAFT_CHARS)))
    spoken = F.concat(draft, F.array(event("regenerate", F.lit(""))), F.transform(pieces, lambda x: event("delta", x)))
    written = F.concat(draft, F.transform(pieces, lambda x, k: F.struct(F.when(k == 0, "edit").otherwise("delta").alias("kind"), x.alias("text"))))
    log = ordered.select("conv_id", "turn", "message", "role", F.posexplode(F.when(F.col("role") == "assistant", spoken).otherwise(written)).alias("k", "e"))
    seq = F.col("turn") * (1 << TURN_BITS) + F.col("k")
    return log.select("conv_id", seq.alias("seq"), "message", F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "open", F.col("role")).otherwise("").alias("role"), F.col("e.text").alias("text"))


class Message:
    """The state of one message: where it was opened, its role, and what stands of it."""

    __slots__ = ("live", "parts", "place", "role")

    def __init__(self) -> None:
        self.live, self.place, self.role, self.parts = False, 0, "", []

    def apply(self, seq: int, kind: str, role: str, text: str) -> None:
        if kind == "delta":
            self.parts.append(text)
        elif kind == "edit":
            self.parts = [text]
        elif kind == "regenerate":
            self.parts = []
        elif kind == "open":
            self.live, self.place, self.role, self.parts = True, seq, role, []
        elif kind == "delete":
            self.live = False


def _turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{BODY}{escape(text)}{END}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], sizes: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; a batch ends at 10,000 rows or where the strings in column `sizes` exceed 8 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sizes])
        if len(held) >= 10_000 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _folded(batches: Iterator[pa.RecordBatch], by_message: bool = False) -> Iterator[tuple[int | None, list[tuple[int, str, str]]]]:
    """(conv_id, messages (place, role, text) in order) of events sorted by conv_id and seq, of which one conversation's messages are held; or,
    by_message, (conv_id, one message) of events sorted by conv_id, message and seq."""
    now, messages = None, {}

    def closed() -> list[tuple[int, str, str]]:
        return sorted((m.place, m.role, "".join(m.parts)) for m in messages.values() if m.live)

    for conv_id, seq, message, kind, role, text in _rows(batches):
        if messages and (conv_id != now or by_message and message not in messages):
            yield now, closed()
            messages = {}
        now = conv_id
        if (m := messages.get(message)) is None:
            m = messages[message] = Message()
        m.apply(seq, kind, role, text)
    if messages:
        yield now, closed()


def _render_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((c, 0, "".join(_turn(role, text) for _, role, text in messages)) for c, messages in _folded(batches) if messages)
    yield from _batches(rows, ["conv_id", "piece", "formatted"], [pa.int64(), pa.int64(), pa.string()], 2)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((c, *m) for c, messages in _folded(batches, True) for m in messages)
    yield from _batches(rows, ["conv_id", "place", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()], 3)


def _render_pieces(piece_chars: int):
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages in order to pieces; a piece is numbered by its task and its place in it, which range partitions keep in order."""

        def pieces() -> Iterator[tuple]:
            from pyspark import TaskContext

            number, parts, size, now = TaskContext.get().partitionId() << 32, [], 0, None
            for conv_id, _, role, text in _rows(batches):
                if parts and (conv_id != now or size > piece_chars):
                    yield now, number, "".join(parts)
                    number, parts, size = number + 1, [], 0
                now = conv_id
                parts.append(_turn(role, text))
                size += len(parts[-1])
            if parts:
                yield now, number, "".join(parts)

        yield from _batches(pieces(), ["conv_id", "piece", "formatted"], [pa.int64(), pa.int64(), pa.string()], 2)

    return render


def _tidy(events: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message").cast("long").alias("message"), empty("kind"), empty("role"), empty("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of a log (EVENTS), each message folded by itself, so that no conversation is held as a whole."""
    dealt = _tidy(events).repartition(task_partitions(events.sparkSession), "conv_id", "message")
    return dealt.sortWithinPartitions("conv_id", "message", "seq", "kind", "text").mapInArrow(_fold, "conv_id long, place long, role string, text string")


def render(events: DataFrame, most_bytes: int = MOST_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """FORMATTED of a log (EVENTS): one string per conversation, `whole`; of one larger than most_bytes, pieces in order, each of whole messages.
    What stands between an assistant's text mark and the end is under the loss mask."""
    log, parts = _tidy(events), task_partitions(events.sparkSession)
    hot = materialize(log.groupBy("conv_id").agg(F.sum(F.octet_length("text") + F.lit(64)).alias("size")).where(F.col("size") > most_bytes).select(F.col("conv_id").alias("_hot")), "hot")
    n_hot = hot.count()
    hot = small_or_shuffled(hot, n_hot)
    among = F.col("conv_id").eqNullSafe(F.col("_hot"))
    usual = log.join(hot, among, "left_anti") if n_hot else log
    usual = usual.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "text")
    whole = usual.mapInArrow(_render_whole, FORMATTED).withColumn("whole", F.lit(True))
    if not n_hot:
        return whole
    order = ["conv_id", "place", "role", "text"]
    messages = materialize(fold(log.join(hot, among, "left_semi")), "messages").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return whole.unionByName(materialize(messages.mapInArrow(_render_pieces(piece_chars), FORMATTED), "pieces").withColumn("whole", F.lit(False)))


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with `turns` (array of role and text) and `loss` (array of texts under the mask), read from the strings alone."""
    turn = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    one = lambda x: F.struct(
        unescape(F.substring_index(x, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text")
    )
    turns = F.transform(turn, one)
    return formatted.withColumn("turns", turns).withColumn("loss", F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]))


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGESTS of pieces sorted by conversation and piece: digests go on from piece to piece, one piece is held."""

    def digests() -> Iterator[tuple]:
        now, state = None, None
        for conv_id, _, turns, n, loss, loss_chars, chars in _rows(batches):
            if state is not None and conv_id != now:
                yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                state = None
            state, now = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv_id
            state[0] += n
            state[1].update(turns)
            state[2] += loss_chars
            state[3].update(loss)
            state[4] += chars
        if state is not None:
            yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    yield from _batches(digests(), DIGESTS.split()[::2], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], 2)


def digests(parsed: DataFrame) -> DataFrame:
    """DIGESTS, one row per conversation of parse(): whole ones where they lie; pieces are brought together by conversation and read as a stream."""
    turns = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss")
    n, chars, loss_chars = F.size("turns").cast("long"), F.length("formatted").cast("long"), F.length(loss).cast("long")
    whole = parsed.where("whole").select(
        "conv_id", n.alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), loss_chars.alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), chars.alias("formatted_chars"),
    )
    pieces = parsed.where("not whole").select("conv_id", "piece", turns.cast("binary").alias("turns"), n.alias("n"), loss.cast("binary").alias("loss"), loss_chars.alias("loss_chars"), chars.alias("chars"))
    met = pieces.repartition(task_partitions(parsed.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(met.mapInArrow(_digest_pieces, DIGESTS))


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), coded AS (
  SELECT *, replace(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3') AS t2,
    replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3') AS r2 FROM rows_
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t2) + length(r2) + 23) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
