"""Chat formatting by a visitor over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them
in order: text is escaped, every other part becomes a placeholder of its kind; its number
inside the turn and its reference are recorded, and its expanded token count follows from its
kind and measures. Turns are wrapped in template marks; the loss mask covers the texts of
assistant turns.

Rows are formatted one by one, so no conversation is gathered: a conversation is its rows in
order. ``read_back`` streams the sorted rows through the parser and keeps one running digest.

Control strings inside texts are broken by a backslash behind their first character, so that no
tokenizer finds them there, and backslashes are doubled; ``unescape`` undoes both.

Defined cases: a null text or null content is empty; a null role is an empty role, without
loss; null turns come first; rows of equal turn go by role, then text; repeated rows are
turns each; a null conversation id is a conversation; a part of null kind is a text, one of an
unknown kind goes as a document under its own kind; null or missing measures count one tile,
one page or no seconds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: The template's marks and the control strings of common chat templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = (
    TURN, BODY, END, "<|image|>", "<|audio|>", "<|document|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Tokens of a part: image tiles, audio frames and document pages.
IMAGE_TILE, TOKENS_A_TILE, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 336, 144, 25, 512

CONTROLS = re.compile("|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)) + r"|\\")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "formatted string, loss array<struct<start:bigint,end:bigint>>, "
    "attachments array<struct<place:int,kind:string,ref:string,tokens:bigint>>"
)


def escape(text: str) -> str:
    return CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Visitor:
    """Flattens the parts of one turn; one method per kind of part."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind: Callable[[dict], None] = getattr(self, f"on_{part.get('kind') or 'text'}", self.on_document)
        kind(part)

    def on_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def on_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 1) / IMAGE_TILE) * math.ceil((part.get("height") or 1) / IMAGE_TILE)
        self.attach(part, tiles * TOKENS_A_TILE)

    def on_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0.0) * AUDIO_TOKENS_A_SECOND))

    def on_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 1) * TOKENS_A_PAGE)

    def attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments)
        kind = part["kind"] if part["kind"] in ("image", "audio") else "document"
        self.pieces.append(f"<|{kind}|>")
        self.attachments.append({"place": place, "kind": part["kind"], "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    """The turn's template text, its loss spans in code points, and its attachments."""
    visitor = Visitor()
    for part in parts or []:
        visitor.visit(part)
    head, body = f"{TURN}{escape(role or '')}{BODY}", "".join(visitor.pieces)
    loss = [{"start": len(head), "end": len(head) + len(body)}] if role == ASSISTANT else []
    return {"formatted": head + body + END, "loss": loss, "attachments": visitor.attachments}


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, parts)``: conv_id, turn, formatted, loss, attachments.

    Sorted inside partitions by conversation and turn.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(r.as_py(), p.as_py()) for r, p in zip(batch.column("role"), batch.column("parts"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"),
                 pa.array([x["formatted"] for x in out], pa.string()),
                 pa.array([x["loss"] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([x["attachments"] for x in out], pa.list_(pa.struct(
                     [("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))],
                ["conv_id", "turn", "formatted", "loss", "attachments"],
            )

    kinds = dict(turns.dtypes)
    ordered = (
        turns.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    )
    return ordered.mapInArrow(code, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {FORMATTED}")


def text_turns(conversations: DataFrame) -> DataFrame:
    """Plain ``conversations(conv_id, turn, role, text)`` as turns of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in
        (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
    ])
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


MARKED = re.compile(re.escape(TURN) + r"((?:\\.|[^\\])*?)" + re.escape(BODY) + r"((?:\\.|[^\\])*?)" + re.escape(END), re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn, unescaped."""
    found = MARKED.fullmatch(formatted)
    if not found:
        raise ValueError("Not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from rows that lie sorted by conversation and turn.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The state is one
    conversation's digests, so a conversation of any length passes in constant memory.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = dict(formatted.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        state, id_type = None, None
        for batch in batches:
            id_type, rows = batch.schema.field("conv_id").type, []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or state[0] != conv:
                    if state:
                        rows.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    learnt = unescape(text[span["start"]:span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if rows:
                yield closed(rows)
        if state:
            yield closed([[state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]])

    return formatted.mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
