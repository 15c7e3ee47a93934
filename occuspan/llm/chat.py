"""Chat formatting of turns whose content is a list of typed parts.

A visitor walks over a turn's parts and flattens them: text is escaped and written,
an image, an audio clip or a document becomes a placeholder, recorded as an attachment
with its reference, its place and the tokens it expands to. The template writes

    <|im_start|>role\\n content <|im_end|>\\n

(without the blanks) for each turn. `<|` occurs in the output only where the template
or a placeholder wrote it: in roles and texts every `<`, backslashes, `|` gets one more
backslash, which reading back takes away again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occuspan.llm.common import quoted, shared_folder, stage
from occuspan.operators.numbering import number_rows

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|attachment|>"}
TAKEN_MARK = re.compile("|".join(map(re.escape, PLACEHOLDER.values())))
TO_ESCAPE, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ATTACHMENT = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]
)
MADE = [
    ("formatted", T.StringType(), pa.string()),
    ("n_chars", T.LongType(), pa.int64()),
    ("loss", T.ArrayType(SPAN), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", T.ArrayType(ATTACHMENT), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
    ("attachment_tokens", T.LongType(), pa.int64()),
]


def escape(text: str) -> str:
    return TO_ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "<" in text else text


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that attachments expand to; `unknown` where a size is missing or not above zero."""

    image_patch: int = 28
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 512
    unknown: int = 256

    def image(self, part: dict) -> int:
        width, height = part.get("width") or 0, part.get("height") or 0
        return -(-width // self.image_patch) * -(-height // self.image_patch) if width > 0 and height > 0 else self.unknown

    def audio(self, part: dict) -> int:
        seconds = part.get("seconds") or 0.0
        return math.ceil(seconds * self.audio_tokens_a_second) if 0 < seconds < math.inf else self.unknown

    def document(self, part: dict) -> int:
        pages = part.get("pages") or 0
        return pages * self.document_tokens_a_page if pages > 0 else self.unknown

    def other(self, part: dict) -> int:
        return self.unknown


@dataclass
class Visitor:
    """Flattens the parts of one turn, in order."""

    costs: TokenCosts
    written: list[str] = field(default_factory=list)
    length: int = 0
    pending: list[str] = field(default_factory=list)
    texts: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("type") or ("text" if part.get("ref") is None else "other")
        if kind == "text":
            # Neighbouring texts are joined before they are escaped: a mark may span them.
            self.pending.append(part.get("text") or "")
        else:
            self.attach(kind if kind in PLACEHOLDER else "other", part)

    def attach(self, kind: str, part: dict) -> None:
        self.close_text()
        tokens = getattr(self.costs, kind)(part)
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.write(PLACEHOLDER[kind])

    def close_text(self) -> None:
        if text := escape("".join(self.pending)):
            self.texts.append({"start": self.length, "end": self.length + len(text)})
            self.write(text)
        self.pending.clear()

    def write(self, text: str) -> None:
        self.written.append(text)
        self.length += len(text)


def format_turn(role: str | None, parts: list[dict | None], trained: frozenset[str], costs: TokenCosts) -> tuple:
    """(formatted text, its code points, spans under the loss mask, attachments, their tokens)."""
    visitor = Visitor(costs)
    visitor.write(START + escape(role or "").replace("\n", LINE) + "\n")
    for part in parts:
        visitor.visit(part)
    visitor.close_text()
    visitor.write(END + "\n")
    loss = visitor.texts if role in trained else []
    return "".join(visitor.written), visitor.length, loss, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders are left out of the text."""
    head, _, rest = formatted.partition("\n")
    content, mark, after = rest.partition(END)
    if not head.startswith(START) or not mark or after != "\n":
        raise ValueError("not one formatted turn")
    role = unescape(head[len(START) :].replace(LINE, "\n"))
    return role, "".join(map(unescape, TAKEN_MARK.split(content) if "<|" in content else [content]))


def format_turns(
    messages: DataFrame,
    role: str = "role",
    text: str = "text",
    parts: str | None = None,
    trained: tuple[str, ...] = ("assistant",),
    costs: TokenCosts = TokenCosts(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Each turn formatted, with `formatted`, `n_chars` (code points), `loss`, `attachments`, `attachment_tokens`.

    The content is the column `parts`, an array of structs with `type` and, as far as
    they have them, `text`, `ref`, `width`, `height`, `seconds` and `pages`; where it is
    null or not named, the column `text` is the only part. Null texts, roles and parts
    are empty; a part of another type gets the placeholder `<|attachment|>`, one without
    a type is text unless it has a reference. `loss` are spans of the formatted text, one
    for each run of text in a turn of a `trained` role; placeholders are under no mask.
    Kept columns, all by default, give way to results of their name. Rows are treated
    alike wherever they are, so repeated rows and empty tables need no rule.
    """
    new = {name for name, _, _ in MADE}
    keep = [c for c in (messages.columns if keep is None else keep) if c.lower() not in new]
    own = [f"__c{i}" for i in range(len(keep))]
    kept_fields = [T.StructField(o, messages.schema[c].dataType) for o, c in zip(own, keep, strict=True)]
    schema = T.StructType(kept_fields + [T.StructField(n, t) for n, t, _ in MADE])
    names, kinds, roles = schema.names, [k for _, _, k in MADE], frozenset(trained)
    given = [quoted(role).cast("string").alias("__role"), quoted(text).cast("string").alias("__text")]
    if parts is not None:
        given.append(quoted(parts).alias("__parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, (said, plain, *listed) = batch.columns[: len(keep)], (c.to_pylist() for c in batch.columns[len(keep) :])
            contents = [[{"type": "text", "text": t}] if p is None else p for t, p in zip(plain, listed[0] if listed else [None] * len(plain), strict=True)]
            made = [format_turn(r, c, roles, costs) for r, c in zip(said, contents, strict=True)]
            columns = zip(*made, strict=True) if made else [[] for _ in MADE]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    private = messages.select(*(quoted(c).alias(o) for c, o in zip(keep, own, strict=True)), *given)
    return private.mapInArrow(run, schema).select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), *(n for n, _, _ in MADE))


def place_turns(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Formatted turns with `seq`, from 1, and `start`, the code points ahead of them in their conversation.

    The conversation's text is its turns' texts one after the other; spans and
    attachments move by `start`. Rows of the same turn follow each other by a hash of
    their text; a null conversation is one conversation, a null turn comes first.
    Numbers come from range partitions, so a conversation may hold any share of the rows.
    """
    rows = stage(turns.drop("seq", "start").withColumn("__tie", F.xxhash64("formatted")), shared_folder(turns.sparkSession), "turns")
    return number_rows(rows, conversation, [turn, "__tie"], "seq", {"start": F.col("n_chars")}).drop("__tie")


class Reader:
    """What is read back from the turns of one conversation, as they come."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def read(self, formatted: str, loss: list[dict]) -> None:
        role, text = parse_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        masked = "".join(unescape(formatted[span["start"] : span["end"]]) for span in loss)
        self.loss.update(masked.encode())
        self.n_turns += 1
        self.loss_chars += len(masked)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Per conversation what its formatted turns say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 covers role, \\n, text, \\n of each turn, loss_sha256 the unescaped text
    under the loss mask. Turns are ordered as by place_turns and read one at a time, so a
    conversation of any length needs the memory of one turn; a digest over one
    conversation can't be made by several tasks. An empty table gives an empty table.
    """
    fields = [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]
    key = turns.schema[conversation]
    schema = T.StructType([T.StructField(key.name, key.dataType)] + [T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in fields])
    kinds = [pa.int64() if t == "long" else pa.string() for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            whose, done = batch.column(0), []
            for c, formatted, loss in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if reader is None or c != at:
                    if reader is not None:
                        done.append((at, *reader.row()))
                    at, reader = c, Reader()
                reader.read(formatted, loss)
            if done:
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], whose.type), *(pa.array(v, k) for v, k in zip(columns[1:], kinds, strict=True))], names=schema.names)
            kind = whose.type
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), *(pa.array([v], k) for v, k in zip(reader.row(), kinds, strict=True))], names=schema.names)

    slim = turns.select(quoted(conversation).alias("__c"), "formatted", "loss", quoted(turn).alias("__t"), F.xxhash64("formatted").alias("__tie"))
    ordered = slim.repartition("__c").sortWithinPartitions("__c", "__t", "__tie")
    return ordered.select("__c", "formatted", "loss").mapInArrow(run, schema)
