"""Chat formatting with typed content parts.

A message has a role and content: a list of parts (text, image, audio, document). A visitor flattens
the parts into one string with an ordered placeholder for every attachment, and records the
attachment's reference and the number of tokens that the placeholder stands for. Messages become
segments of a template; control strings inside texts are escaped, so that every segment can be read
back.

A segment is ``<|turn|>`` role ``<|says|>`` content ``<|end|>`` newline. Within role and content a
backslash is doubled and ``<|`` becomes ``<\\|``, so ``<|`` occurs in nothing but control strings. A
placeholder is ``<|kind:n|>`` with the attachment's number in its message. The loss mask covers the
content of assistant turns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = ("conv_id long, turn long, segment string, loss_start int, loss_end int, "
           "attachments array<struct<position:int,kind:string,ref:string,tokens:int>>, expanded_tokens long")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 600  # pixels a patch side, tokens a second, tokens a page


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one message in order."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.run: list[str] = []  # neighbouring texts, escaped as one: a control string may span them
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:  # an unknown kind stays visible as its text
            self.visit_text(part)
        else:
            visitor(part)

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def body(self) -> str:
        self._close_run()
        return "".join(self.out)

    def _close_run(self) -> None:
        self.out.append(escape("".join(self.run)))
        self.run.clear()

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(side) or 0) / PATCH) for side in ("width", "height"))
        self._attach("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 0) * PAGE_TOKENS))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self._close_run()
        self.out.append(f"<|{kind}:{n}|>")
        self.attachments.append({"position": n, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def format_message(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict]]:
    """(segment, start and end of the loss mask in it, attachments). Start and end are equal where
    nothing is learned. A null role is empty, null content has no parts."""
    visitor = Flattener()
    for part in parts or ():
        if part is not None:
            visitor.visit(part)
    body = visitor.body()
    head = f"{TURN}{escape(role or '')}{SAYS}"
    start = len(head)
    return (head + body + END, start, start + len(body) if role == "assistant" else start, visitor.attachments)


def read_segment(segment: str) -> tuple[str, str, list[tuple[str, int]]]:
    """(role, text without placeholders, placeholders) of a segment."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a segment")
    role, _, body = segment[len(TURN):-len(END)].partition(SAYS)
    return unescape(role), unescape(_HOLDER.sub("", body)), [(k, int(n)) for k, n in _HOLDER.findall(body)]


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 content: str = "content") -> DataFrame:
    """One segment per message (``SEGMENT``); ``content`` is an array of ``PART`` structs (fields may
    be missing). Narrow: no message meets another. Expanded tokens count the attachments' tokens.
    """
    columns = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                              F.col(role).alias("role"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int32()),
            ("loss_end", pa.int32()), ("attachments", pa.list_(pa.struct([
                ("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))),
            ("expanded_tokens", pa.int64())])
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                made = [format_message(r, c) for r, c in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("conv_id"), batch.column("turn"), pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()),
                    pa.array([m[3] for m in made], schema.field("attachments").type),
                    pa.array([sum(a["tokens"] for a in m[3]) for m in made], pa.int64())], schema=schema)

    return columns.mapInArrow(run, SEGMENT)


def text_parts(text: str = "text"):
    """Column with plain text as a list of one part; null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text")))


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(segments: DataFrame) -> DataFrame:
    """A row per conversation, read back from the segments (``READ_BACK``).

    The digests are over the turns in order, so one conversation's segments pass through one task;
    they stream in sorted order, and the task keeps two running hashes and no turn. Turns with the
    same number follow the order of their segments. A null conversation id is a conversation.
    """
    ordered = (segments.select("conv_id", "turn", "segment", "loss_start", "loss_end")
               .repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "segment"))

    def run(batches):
        import hashlib
        names = [f.split()[0] for f in READ_BACK.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        class Open:
            def __init__(self, conv):
                self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
                self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

            def row(self):
                return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        now, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv, segment, a, b in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Open(conv)
                role, text, _ = read_segment(segment)
                masked = unescape(_HOLDER.sub("", segment[a:b]))
                now.n, now.loss, now.chars = now.n + 1, now.loss + len(masked), now.chars + len(segment)
                now.turns.update(f"{role}\n{text}\n".encode())
                now.masked.update(masked.encode())
                if len(done) >= 4096:
                    yield emit(done)
                    done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield emit(done)

    return ordered.mapInArrow(run, READ_BACK)
