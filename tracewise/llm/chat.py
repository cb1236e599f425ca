"""Op 8. Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only
its reply is trainable. A conversation's examples are prefixes of one rendered text, because
a turn is rendered without regard to later turns. So an example is stored as a span of that
text (its end, the reply's start and length), which keeps a conversation of n turns at n
rendered turns rather than n squared. texts_of() makes a row of each with its context and its
reply. Turns after the last reply make one more example without a trainable part, so no turn is
lost.

Template: user `[INST] x [/INST]`, system `[SYS] x [/SYS]`, assistant `[ANS] x </s>`, another
role r `[ROLE=r] x [/ROLE]`; the text starts with `<s>`. Inside x and r a backslash goes before
each backslash, `<` and `[`, so no control string can arise there, and taking it away again
gives the text back.

Cases: null text and null role are empty strings. Turns go by turn number, equal numbers by
role and text, null first; repeated rows stay. Null conv_id is a conversation. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import store

#: Turns that are gathered before a conversation's blocks meet.
BLOCK = 64

OPEN = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[ANS] "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": " </s>"}
ROLE = {" [/INST]": "user", " [/SYS]": "system", " </s>": "assistant"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The conversation's text, and (end, reply start, reply length) of each example."""
    out, at, spans = ["<s>"], 3, []
    for role, text in turns:
        head = OPEN.get(role) or f"[ROLE={escape(role).replace(']', chr(92) + ']')}] "
        body, tail = escape(text), CLOSE.get(role, " [/ROLE]")
        out += [head, body, tail]
        start = at + len(head)
        at = start + len(body) + len(tail)
        if role == "assistant":
            spans.append((at, start, len(body)))
    if not spans or spans[-1][0] < at:
        spans.append((at, at, 0))
    return "".join(out), spans


#: Possessive, so that a long text needs no memory for ways back.
TURN = re.compile(r"(?:\[INST\] |\[SYS\] |\[ANS\] |\[ROLE=((?:[^\\\]]++|\\.)*+)\] )((?:[^\\<\[]++|\\.)*+)(\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])", re.S)


def read(text: str) -> list[tuple[str, str]]:
    """Turns of a rendered text. ValueError if it isn't one."""
    if not text.startswith("<s>"):
        raise ValueError("no start")
    at, out = 3, []
    while at < len(text):
        found = TURN.match(text, at)
        if not found or not found[2].endswith(" "):
            raise ValueError(f"no turn at {at}")
        role = unescape(found[1]) if found[1] is not None else ROLE[f" {found[3]}"]
        out.append((role, unescape(found[2][:-1])))
        at = found.end()
    return out


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose two turns both say a control string."""
    spark = conversations.sparkSession
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def gathered(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, gathered block by block."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.floor(F.col("turn") / BLOCK)
    return (
        conversations.groupBy("conv_id", block.alias("block"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", lambda b: b["turns"])).alias("turns"))
    )


def _turns(row: list[dict]) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in row]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text, and its examples as array<struct<end, reply_start, reply_chars>>."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("end", pa.int64()), ("reply_start", pa.int64()), ("reply_chars", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [render(_turns(t)) for t in part.column("turns").to_pylist()]
                spans = [[dict(zip(("end", "reply_start", "reply_chars"), s, strict=True)) for s in d[1]] for d in done]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([d[0] for d in done], pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "examples"])

    return gathered(conversations).mapInArrow(run, f"conv_id {kind}, formatted string, examples array<struct<end: bigint, reply_start: bigint, reply_chars: bigint>>")


def texts_of(formatted: DataFrame) -> DataFrame:
    """One row per example: all turns before its reply as context, the reply as rendered, and what closes it. Grows with the square of a conversation's turns, in the task that holds it; nothing of it is shuffled or stored here."""
    e = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    start, chars, end = (F.col(f"e.{c}").cast("int") for c in ("reply_start", "reply_chars", "end"))
    return e.select("conv_id", "example", F.substring("formatted", F.lit(1), start).alias("context"), F.substring("formatted", start + 1, chars).alias("reply"), F.substring("formatted", start + chars + 1, end - start - chars).alias("close"))


def turn_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 of the turns that the formatted text reads back as."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests = [], []
                for text in part.column("formatted").to_pylist():
                    turns, every = read(text), hashlib.sha256()
                    for role, said in turns:
                        every.update(f"{role}\n{said}\n".encode())
                    counts.append(len(turns))
                    digests.append(every.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "n_turns", "turns_sha256"])

    return formatted.select("conv_id", "formatted").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted output says: turns from its texts, trainable text and characters from its examples, a row each."""
    formatted = store(format_conversations(conversations), "formatted")
    replies = F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: F.regexp_replace(x["reply"], r"(?s)\\(.)", "$1"))
    rows = texts_of(formatted).withColumn("chars", sum((F.char_length(c) for c in ("reply", "close")), F.char_length("context")).cast("bigint"))
    own = rows.groupBy("conv_id").agg(F.array_join(replies, "").alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("examples"))
    both = turn_digests(formatted).alias("t").join(own.alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")))
    return both.select("t.conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "examples")
