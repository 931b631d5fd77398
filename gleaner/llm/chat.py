"""Chat formatting by a finite-state machine over roles.

A template states how turns are marked, which roles may follow each other and which texts the model
is trained on. The machine walks through a conversation's turns, notes the first one that is out of
order and emits text segments, each with a loss flag. Control strings inside texts are escaped, so
the output can be read back: between ``<`` and ``|`` one more backslash is put than is there.

A conversation is streamed through one task turn by turn, sorted by Spark, so memory holds one turn
however long the conversation is.

Defined cases: null texts and roles are empty; turns of one conversation are ordered by turn, then
role, then text, nulls first, and repeated rows are turns like others; a null conv_id is a
conversation of its own; unknown roles are formatted without loss and out of order; an empty table
gives an empty result. Columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.base import small_batches

START = "start"


@dataclass(frozen=True)
class Template:
    """What a format is; the machine and the reader know nothing else."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>"
    turn_gap: str = "\n"
    trained: frozenset[str] = frozenset({"assistant"})
    # role or START -> roles that may come next
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    def __post_init__(self) -> None:
        for mark in (self.turn_start, self.turn_end):
            if not mark.startswith("<|"):
                raise ValueError("marks must begin with <|, which escaping keeps out of texts")
        if self.role_end != "\n" or not self.follows.get(START):
            raise ValueError("a role ends its line, and some role must come first")


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def next_state(template: Template, state: str, role: str) -> tuple[str, bool]:
    """The state after a turn, and whether the turn may come here."""
    ok = role in template.follows.get(state, frozenset())
    return (role if role in template.follows else state), ok


SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, in_order boolean"


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn_no, part, text, loss, in_order): head, text and tail of every turn, in order.

    Segments of a conversation lie together in one partition; their texts in a row are its format.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, n = object(), START, 0
        for f in frames:
            out = []
            ids = [None if null else int(i) for i, null in zip(f["conv_id"].fillna(0), f["conv_id"].isna(), strict=True)]
            for c, role, text in zip(ids, f["role"], f["text"], strict=True):
                if c != conv:
                    conv, state, n = c, START, 0
                role, text = role or "", text or ""
                state, ok = next_state(template, state, role)
                head = template.turn_start + escape_role(role) + template.role_end
                out.append((c, n, "head", head, False, ok))
                out.append((c, n, "text", escape(text), role in template.trained, ok))
                out.append((c, n, "tail", template.turn_end + template.turn_gap, False, ok))
                n += 1
            yield _frame(out, SEGMENTS)

    return placed.mapInPandas(run, SEGMENTS)


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


class Reader:
    """Reads one conversation back from its segments' texts, turn by turn."""

    def __init__(self, template: Template) -> None:
        t = template
        self.turn = re.compile(f"{re.escape(t.turn_start)}([^\n]*)\n(.*?){re.escape(t.turn_end + t.turn_gap)}", re.DOTALL)
        self.rest, self.n_turns, self.turns = "", 0, hashlib.sha256()
        self.loss_chars, self.loss, self.chars, self.bad = 0, hashlib.sha256(), 0, None

    def add(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        self.rest += text
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        while m := self.turn.match(self.rest):
            said = f"{unescape_role(m[1])}\n{unescape(m[2])}\n"
            self.turns.update(said.encode("utf-8", "surrogatepass"))
            if not in_order and self.bad is None:
                self.bad = self.n_turns
            self.n_turns += 1
            self.rest = self.rest[m.end() :]

    def digest(self) -> tuple:
        if self.rest:
            raise ValueError("a turn does not end")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.bad


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_bad_turn long"


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, parsed from the texts of ``segments`` as they lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, reader = object(), None
        for f in frames:
            out = []
            ids = [None if null else int(i) for i, null in zip(f["conv_id"].fillna(0), f["conv_id"].isna(), strict=True)]
            for c, text, loss, ok in zip(ids, f["text"], f["loss"], f["in_order"], strict=True):
                if c != conv:
                    if reader:
                        out.append((conv, *reader.digest()))
                    conv, reader = c, Reader(template)
                reader.add(text, loss, ok)
            yield _digests(out)
        if reader:
            yield _digests([(conv, *reader.digest())])

    def _digests(rows: list[tuple]) -> pd.DataFrame:
        out = _frame(rows, DIGESTS)
        out["first_bad_turn"] = out["first_bad_turn"].astype("Int64")
        return out

    return formatted.mapInPandas(run, DIGESTS)


def conversations_text(formatted: DataFrame) -> DataFrame:
    """(conv_id, text, loss_spans): whole formatted texts, for conversations that fit in a row."""
    part = F.struct("turn_no", F.when(F.col("part") == "head", 0).when(F.col("part") == "text", 1).otherwise(2).alias("k"), "text", "loss")
    got = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.transform("parts", lambda p: p["loss"]).alias("loss"))


def with_marked_conversation(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts hold control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)
