"""Chat formatting (operator 1): offset-aligned loss masks over whole rendered conversations.

A conversation is rendered as one text in which control strings mark its turns; control strings inside roles and texts are
escaped reversibly. The text is encoded once, with the control strings as added tokens, so no token crosses a turn's edge.
The turns to learn from are sorted spans of code points; the tokens' offsets are found in them by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, staged, table

#: Turns that are rendered and encoded together; a longer conversation goes on in further parts.
PART_TURNS = 4096
TOKENIZER = "byte_bpe_50k.json"


@dataclass(frozen=True)
class Template:
    """A turn is ``turn`` role ``body`` text ``end``. Control strings start with < or [, which occur in them nowhere else, and have no backslash."""

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "</s>"
    #: Strings that are control strings elsewhere; they are escaped too.
    reserved: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<|startoftext|>", "<|endoftext|>")

    @cached_property
    def _controls(self) -> tuple[re.Pattern, re.Pattern]:
        strings = {self.turn, self.body, self.end, *self.reserved}
        if any(not re.fullmatch(r"[<\[][^<\[\\]+", x) for x in strings):
            raise ValueError("a control string starts with < or [ and holds no other of them and no backslash")
        starts = {a: "|".join(sorted(re.escape(x[1:]) for x in strings if x[0] == a)) for a in "<["}
        forms = "|".join(f"{re.escape(a)}(?=\\\\*(?:{b}))" for a, b in starts.items() if b)
        back = "|".join(f"{re.escape(a)}(?=\\\\+(?:{b}))" for a, b in starts.items() if b)
        return re.compile(forms), re.compile(f"({back})\\\\")

    def escape(self, text: str) -> str:
        """A backslash goes in after the first character of each control string, and of each that has some there already."""
        return self._controls[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._controls[1].sub(lambda m: m[1], text)

    def render(self, turns: list[tuple[str, str]], learn: tuple[str, ...]) -> tuple[str, np.ndarray]:
        """The text, and the sorted spans (start, end) of the texts whose role is in ``learn``."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, own = f"{self.turn}{self.escape(role)}{self.body}", self.escape(text)
            if role in learn and own:
                spans.append((at + len(head), at + len(head) + len(own)))
            out += [head, own, self.end]
            at += len(head) + len(own) + len(self.end)
        return "".join(out), np.array(spans, np.int64).reshape(-1, 2)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a rendered text."""
        turns = [x[: -len(self.end)].split(self.body) for x in text.split(self.turn)[1:]]
        return [(self.unescape(role), self.unescape(own)) for role, own in turns]


def load_tokenizer(path: str, template: Template):
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (template.turn, template.body, template.end)])
    return t


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie inside a span. offsets: (tokens, 2), spans: (n, 2), both sorted."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 0] < offsets[:, 1])


def part_of(turn: Column, part_turns: int = PART_TURNS) -> Column:
    return F.coalesce(F.floor(turn.cast("long") / part_turns), F.lit(-(1 << 62))).cast("long")


FORMATTED = "conv_id long, part long, n_turns long, text string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, tokenizer: str | None = None, template: Template = Template(), learn: tuple[str, ...] = ("assistant",), part_turns: int = PART_TURNS, then: Callable | None = None, schema: str = FORMATTED) -> DataFrame:
    """(conv_id, part, n_turns, text, input_ids, token_starts, token_ends, loss_mask) of conversations given as rows (conv_id, turn, role, text).

    Turns go by ``turn`` (null first), ties by role and text; null roles and texts are empty; repeated rows are turns of
    their own; rows with a null conv_id are one conversation. ``part`` counts from turn 0 in steps of ``part_turns`` turn
    numbers (null turns come before all parts): a conversation has one part unless it has more turns than that, and its
    parts, in order, are its text. An empty text has no token under the mask. An empty table gives an empty result; other
    columns are ignored. ``then`` reads the formatted batches, sorted by (conv_id, part), where they are made, and gives rows of ``schema``.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), part_of(F.col("turn"), part_turns).alias("part"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(path, template)

        def made(groups: list[tuple]) -> pa.RecordBatch:
            texts, spans = zip(*(template.render(own, learn) for _, own in groups), strict=True)
            coded = coder.encode_batch(list(texts), add_special_tokens=False)
            offsets = [np.array(c.offsets, np.int64).reshape(-1, 2) for c in coded]
            ends = np.concatenate([[0], np.cumsum([len(o) for o in offsets])]).astype(np.int32)
            flat = np.concatenate(offsets).astype(np.int32)
            lists = (np.concatenate([np.array(c.ids, np.int32) for c in coded]), flat[:, 0], flat[:, 1], np.concatenate([mask(o, s) for o, s in zip(offsets, spans, strict=True)]))
            columns = [pa.array([k[i] for k, _ in groups], pa.int64()) for i in (0, 1)]
            columns += [pa.array([len(own) for _, own in groups], pa.int64()), pa.array(texts, pa.string())]
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x))) for x in lists]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "text", "input_ids", "token_starts", "token_ends", "loss_mask"])

        groups: list[tuple] = []
        size = 0
        for batch in batches:
            for conv, number, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if not groups or groups[-1][0] != (conv, number):
                    if size > 1 << 20:
                        yield made(groups)
                        groups, size = [], 0
                    groups.append(((conv, number), []))
                groups[-1][1].append((role, text))
                size += len(text)
        if groups:
            yield made(groups)

    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, under: np.ndarray, template: Template = Template()) -> str:
    """All text under the mask, unescaped: each run of tokens that touch is one text."""
    lo, hi = starts[under], ends[under]
    if not len(lo):
        return ""
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]))
    past = np.append(first[1:], len(lo)) - 1
    return "".join(template.unescape(text[a:b]) for a, b in zip(lo[first].tolist(), hi[past].tolist(), strict=True))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (conv_id, part); each conversation is digested as it streams by."""
    template, now, begun = Template(), None, False
    fields = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    n = loss = chars = 0
    turns = learnt = hashlib.sha256()
    done: list[tuple] = []
    for batch in batches:
        for conv, text, starts, ends, under in zip(*(batch.column(c) for c in ("conv_id", "text", "token_starts", "token_ends", "loss_mask")), strict=True):
            if not begun or conv.as_py() != now:
                if begun:
                    done.append((now, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))
                now, begun, n, loss, chars, turns, learnt = conv.as_py(), True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            text = text.as_py()
            for role, own in template.parse(text):
                n += 1
                turns.update(f"{role}\n{own}\n".encode())
            said = masked_text(text, *(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, under)), template)
            loss, chars = loss + len(said), chars + len(text)
            learnt.update(said.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], fields)
            done = []
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((now, n, turns.hexdigest(), loss, learnt.hexdigest(), chars), kinds, strict=True)], fields)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: More conversations of several parts than this are told apart by a shuffle instead of a broadcast.
MOST_LONG = 100_000


def digested(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Digests of formatted conversations, read back from the formatted rows, one row a conversation.

    Those of one part are digested where they are formatted. The parts of longer ones are formatted apart, wherever they are,
    and then meet: a digest is made in order.
    """
    ends = turns.select(F.col("conv_id").cast("long").alias("long_id"), part_of(F.col("turn"), part_turns).alias("part")).groupBy("long_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    several = staged(ends.where("a <> b").select("long_id"), "long-conversations")
    n = several.count()
    if not n:
        return format_conversations(turns, part_turns=part_turns, then=_digest, schema=DIGEST)
    several = F.broadcast(several) if n <= MOST_LONG else several
    same = F.col("conv_id").cast("long").eqNullSafe(F.col("long_id"))
    short = format_conversations(turns.join(several, same, "left_anti"), part_turns=part_turns, then=_digest, schema=DIGEST)
    parts = format_conversations(turns.join(several, same, "left_semi"), part_turns=part_turns).drop("n_turns", "input_ids")
    parts = parts.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return short.unionAll(parts.mapInArrow(_digest, DIGEST))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose texts are control strings: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Null roles and texts are empty, null turns come first, ties go by role and text, repeated rows are turns of their own, rows with a
    null conv_id are one conversation, no rows leave conversation -1; other columns are ignored.
    """
    say = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", say), (-1, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    return digested(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(more))


#: The digests of the turns are plain SQL; formatted_chars counts a character more for each control string, and each that is escaped already.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*(\|turn\|>|\|text\|>|/s>|s>|\|startoftext\|>|\|endoftext\|>)|\[\\*(INST\]|/INST\])')) AS escapes FROM c
)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 8 + length(text) + 4 + escapes)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
