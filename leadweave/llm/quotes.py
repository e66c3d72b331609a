"""Quotation linking: reply-ordered conversations without quotes.

A message's lines are parsed into quote levels (leading `>`). Passages of one level are normalised and split into
sentences, which are hashed; a quoted sentence is joined to the first message of its conversation that wrote it
itself. A message replies to the message that wrote most of what it quotes at the lowest level. Reply chains are
followed in order of turn, in long conversations by doubling the reply pointers.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadweave.llm.words import chunks
from leadweave.storage import materialise, small_or_merge

#: Most replies of a conversation that one task walks in order (some 100 bytes each).
LONG = 1000
#: Most ids of longer conversations that are broadcast.
BROADCAST_CONVERSATIONS = 100_000

_QUOTE = re.compile(r"(?:[ \t]*>)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_INTRO = re.compile(r"^\s*(?:On\b.{0,200}\bwrote|.{0,100}<[^>]*@[^>]*>.{0,20}\bwrote|-{2,}\s*Original Message\s*-{2,}):?\s*$", re.I)


def parse_levels(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) in order: runs of lines of one quote level; lines that introduce a quote are left out."""
    out: list[tuple[int, list[str]]] = []
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        m = _QUOTE.match(line)
        level = m.group().count(">") if m else 0
        body = line[m.end() :].removeprefix(" ") if m else line
        if _INTRO.match(body):
            after = next((x for x in lines[k + 1 :] if x.strip()), "")
            n = _QUOTE.match(after)
            if (n.group().count(">") if n else 0) > level:
                continue
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(body)) for level, body in out]


def sentences(passage: str) -> list[str]:
    """Normalised sentences of a passage: lower case, letters and digits only, line breaks don't count."""
    found = (re.sub(r"[\W_]+", " ", s).strip().lower() for s in _SENTENCE.split(" ".join(passage.split())))
    return [s for s in found if s]


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), said: array<struct<level, hash, chars>> of its sentences."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}

    def run(batches):
        for batch in chunks(batches):
            own, first, level, hashes, chars = [], [0], [], [], []
            for text in batch.column("text").to_pylist():
                levels = parse_levels(text)
                own.append("\n".join(p for k, p in levels if not k).strip("\n"))
                for k, passage in levels:
                    found = sentences(passage)
                    level += [k] * len(found)
                    hashes += [xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in found]
                    chars += [len(s) for s in found]
                first.append(len(level))
            parts = [pa.array(level, pa.int32()), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(chars, pa.int32())]
            said = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(parts, ["level", "hash", "chars"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), pa.array(own, pa.string()), said], names=[*kinds, "own", "said"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return messages.select(*kinds, "text").mapInArrow(run, f"{schema}, own string, said array<struct<level:int,hash:long,chars:int>>")


def quotation_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, source, chars: how much of what a message quotes at a level a message first wrote."""
    rows = parsed.select("conv_id", "turn", F.inline("said"))
    first = rows.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = rows.filter("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.max("chars").alias("chars"))
    links = quoted.hint("merge").join(first, ["conv_id", "hash"]).filter("source < turn")
    return links.groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").cast("long").alias("chars"))


def replies(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_quoted of quotation_links.

    A message replies to the source of its lowest quote level; of several to that of which it quotes most, of equals
    to the latest.
    """
    best = links.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", F.col("source"))).alias("best"), F.sum("chars").alias("n_quoted"))
    return best.select("conv_id", "turn", F.col("best.source").alias("reply_to"), "n_quoted")


def _walk(batches):
    """Threads of rows that are sorted by conversation and turn: a message comes after the one that it replies to."""
    conv, known = None, {}
    for batch in batches:
        threads, depths = [], []
        for c, turn, up in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "reply_to")), strict=True):
            if c != conv:
                conv, known = c, {}
            thread, depth = known.get(up, (up, 0))
            known[turn] = (thread, depth + 1)
            threads.append(thread)
            depths.append(depth + 1)
        columns = [*batch.columns, pa.array(threads, batch.column("turn").type), pa.array(depths, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "thread", "depth"])


def _doubled(rows: DataFrame) -> DataFrame:
    """Threads by doubling the reply pointers, a join a round: conversations of any length, spread by message."""
    active = materialise(rows.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("steps")), "pointers")
    known, done = active, []
    while not active.isEmpty():
        over = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("steps").alias("more"))
        moved = materialise(active.hint("merge").join(over, ["conv_id", "up"], "left"), "threads")
        done.append(moved.filter("higher IS NULL").select("conv_id", "turn", "up", "steps"))  # at the first message
        active = moved.filter("higher IS NOT NULL").select("conv_id", "turn", F.col("higher").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        known = reduce(DataFrame.unionByName, [active, *done])
    found = reduce(DataFrame.unionByName, done, active).select("conv_id", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))
    return rows.hint("merge").join(found, ["conv_id", "turn"])


def threads(rows: DataFrame, long: int = LONG) -> DataFrame:
    """The written replies with thread and depth: the first message of the chain and the steps to it.

    Conversations of at most `long` replies are walked in order, each within a task; in longer ones the pointers are
    doubled.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    sizes = materialise(rows.groupBy("conv_id").agg(F.count("*").alias("size")).filter(F.col("size") > long).select("conv_id"), "long-conversations")
    short, rest = rows, None
    if not sizes.isEmpty():
        sizes = small_or_merge(sizes, BROADCAST_CONVERSATIONS)
        short, rest = rows.join(sizes, "conv_id", "left_anti"), rows.join(sizes, "conv_id", "left_semi")
    walked = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    walked = walked.mapInArrow(_walk, ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", thread {kinds['turn']}, depth int")
    return walked if rest is None else walked.unionByName(_doubled(materialise(rest, "long-replies")))


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own, reply_to, thread, depth, n_quoted: one row for each message (conv_id, turn, role, text).

    Ordered by conv_id, thread, turn, each message comes after the one that it replies to. A message that quotes no
    earlier message starts a thread at its own turn. Null and empty text has no sentences; rows that share conv_id and
    turn count as one message and share their links; messages of null conv_id or turn link with nothing. Whole texts
    are read, of any length, and no columns but these four. An empty table gives an empty one.
    """
    parsed = materialise(parse_messages(messages), "messages")
    found = materialise(threads(materialise(replies(quotation_links(parsed)), "replies")), "threads")
    out = parsed.select("conv_id", "turn", "role", "own").hint("merge").join(found, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "own", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"))


def quoting_messages(messages: DataFrame) -> DataFrame:
    """The messages as mails: each quotes the turn before, whose mail quotes the one before that.

    Of several rows of one turn the smallest text is quoted (null if all are null), so each row gives one mail.
    """
    turns = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    turns = materialise(turns.filter("text IS NOT NULL"), "turns")
    none = F.lit(None).cast("string")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("text1"), none.alias("text2"))
    before = before.unionByName(turns.select("conv_id", (F.col("turn") + 2).alias("turn"), none.alias("text1"), F.col("text").alias("text2")))
    before = before.groupBy("conv_id", "turn").agg(F.max("text1").alias("text1"), F.max("text2").alias("text2"))
    mails = messages.select("conv_id", "turn", "role", "text").hint("merge").join(before, ["conv_id", "turn"], "left")
    quote = lambda c, mark: F.regexp_replace(c, "(?m)^", mark)
    text = F.concat_ws("\n", quote(F.col("text2"), "> > "), quote(F.col("text1"), "> "), "text")
    return mails.select("conv_id", "turn", "role", text.alias("text"))


def op5_quotes(spark, sf_dir: str) -> DataFrame:
    """Every message of the conversations written as mails that quote, its quotes linked and taken out again."""
    found = link_quotations(quoting_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.select("conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", "thread", "depth", "n_quoted")
