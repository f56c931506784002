"""Chat formatting: a finite-state machine over roles, and a declarative template with a loss flag for each segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn order: from a state, a role leads to the next state. What is not listed is out of order.
TURNS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}


@dataclass(frozen=True)
class Template:
    """How a turn is written, as (text, loss) segments; ``{role}`` and ``{text}`` stand for the turn's own, and loss
    names the role whose turns are learned there (None: no role's are).

    Roles and texts are escaped: a character that begins any control string is written as ``escape`` and a letter,
    so no control string can occur inside a text, and the writing can be undone.
    """

    segments: tuple[tuple[str, str | None], ...] = (("<|turn|>{role}<|text|>", None), ("{text}", "assistant"), ("<|end|>", None))
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    turns: dict = field(default_factory=lambda: TURNS, hash=False)
    ends: tuple[str, ...] = ("assistant",)

    @property
    def codes(self) -> dict[str, str]:
        firsts = sorted({c[0] for c in self.controls})
        return {self.escape: self.escape * 2} | {c: self.escape + chr(ord("a") + i) for i, c in enumerate(firsts)}

    def escaped(self, column: Column) -> Column:
        for char, code in self.codes.items():  # the escape character comes first
            column = F.replace(column, F.lit(char), F.lit(code))
        return column

    def reader(self) -> re.Pattern:
        """Matches a written turn; its groups are the escaped role and text."""
        parts = re.split(r"(\{role\}|\{text\})", "".join(pattern for pattern, _ in self.segments))
        return re.compile("".join(f"(?P<{p[1:-1]}>.*?)" if p in ("{role}", "{text}") else re.escape(p) for p in parts), re.S)

    def unescape(self, text: str) -> str:
        back = {code: char for char, code in self.codes.items()}
        return re.sub(re.escape(self.escape) + ".", lambda m: back[m[0]], text, flags=re.S) if self.escape in text else text


TURN = "conv_id long, turn long, role string, segments array<struct<text:string,loss:boolean>>, state string"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segments")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each turn: conv_id, turn, role, segments (array of text and loss flag), state.

    Segments are written with built-in functions. Rows are then dealt by conv_id and sorted by turn (ties by role and
    written text), and the turn machine walks them as a stream: state is the machine's after the turn, "wrong" from
    the first turn out of order on. Turns out of order are written all the same.

    Null texts and roles count as empty; only the segments of a role that the template names carry loss, whatever
    the roles are called. Null conv_ids form a conversation of their own; other columns are ignored.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for pattern, loss in template.segments:
        pieces = [template.escaped({"{role}": role, "{text}": text}[p]) if p in ("{role}", "{text}") else F.lit(p) for p in re.split(r"(\{role\}|\{text\})", pattern) if p]
        parts.append(F.struct(F.concat(*pieces).alias("text"), (F.lit(False) if loss is None else role == F.lit(loss)).alias("loss")))
    written = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.array(*parts).alias("segments"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, "start"
        for batch in batches:
            states = []
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != key:
                    key, state = conv, "start"
                state = template.turns.get((state, said), "wrong")
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], ["conv_id", "turn", "role", "segments", "state"])

    return _dealt(written).mapInArrow(walk, TURN)


def read_back(formatted: DataFrame, template: Template = Template(), dealt: bool = False) -> DataFrame:
    """One row for each conversation, read from the written segments: digests, sizes, and whether turns are in order.

    Rows are dealt by conv_id and sorted by turn, unless they come straight from ``format_turns`` (``dealt``), and
    each conversation passes through as a stream: running digests are all that is held, so its length does not
    matter. valid is true if the state written with the last turn is one that the template may end in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        whole = template.reader()
        key, fresh, out = None, True, []
        n = loss_chars = chars = 0
        turns_sha = loss_sha = None
        state = None

        def row() -> tuple:
            return key, n, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, state in template.ends

        for batch in batches:
            for conv, segments, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if fresh or conv != key:
                    if not fresh:
                        out.append(row())
                    key, fresh = conv, False
                    n = loss_chars = chars = 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                written = "".join(s["text"] for s in segments)
                found = whole.fullmatch(written)
                role, text = template.unescape(found["role"]), template.unescape(found["text"])
                turns_sha.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        taught = template.unescape(s["text"])
                        loss_chars += len(taught)
                        loss_sha.update(taught.encode())
                n, chars, state = n + 1, chars + len(written), after
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if not fresh:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = formatted if dealt else _dealt(formatted)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return rows.select("conv_id", "segments", "state").mapInArrow(run, schema)
