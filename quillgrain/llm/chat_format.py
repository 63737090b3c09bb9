"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A
visitor flattens them into one string, texts escaped, other parts as numbered
placeholders; it records each attachment's reference and the tokens that a
model will put in the placeholder's stead. A part of another type is kept as an
attachment of kind ``other``, a null part says nothing.

Layout of a turn: ``<|im_start|>role\\n`` content ``<|im_end|>\\n``. In contents
``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, in roles a line feed is
also written ``\\n``; so control strings in the formatted text are the format's
own, and reading back gives the very same roles and texts. Text parts that meet
are escaped as one text, so a control string cut over parts is escaped too.
"""

from __future__ import annotations

import math
import re
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
IMAGE_PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 256

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField(
            "attachments",
            T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("turn", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("tokens", T.LongType())])),
        ),
        T.StructField("n_turns", T.LongType()),
    ]
)
DIGESTS = T.StructType(
    [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


class Attachment(NamedTuple):
    kind: str
    ref: str
    turn: int
    at: int
    tokens: int


class Flattener:
    """Visits the parts of a conversation in order; ``out`` grows by what each one writes."""

    def __init__(self):
        self.out: list[str] = []
        self.size = 0
        self.turn = -1
        self.attachments: list[Attachment] = []
        self.said: list[str] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def flush(self) -> None:
        """Write the texts said since the last placeholder, escaped as one."""
        self.write(escape("".join(self.said)))
        self.said.clear()

    def visit(self, part: Any) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: Any) -> None:
        self.said.append(part["text"] or "")

    def visit_image(self, part: Any) -> None:
        patches = math.ceil((part["width"] or 0) / IMAGE_PATCH) * math.ceil((part["height"] or 0) / IMAGE_PATCH)
        self._attach("image", part, max(1, patches))

    def visit_audio(self, part: Any) -> None:
        self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: Any) -> None:
        self._attach("document", part, max(1, (part["pages"] or 1)) * DOCUMENT_TOKENS_A_PAGE)

    def visit_other(self, part: Any) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: Any, tokens: int) -> None:
        self.flush()
        self.attachments.append(Attachment(kind, part["ref"] or "", self.turn, self.size, tokens))
        self.write(f"<|{kind}:{len(self.attachments) - 1}|>")


def format_conversation(turns: list[tuple[str | None, list[Any]]]) -> dict[str, Any]:
    """(role, parts) in order to the formatted text, loss spans (contents of trained turns) and attachments."""
    visitor, loss = Flattener(), []
    for role, parts in turns:
        visitor.turn += 1
        visitor.write(START + escape(role or "").replace("\n", "\\n") + "\n")
        first = visitor.size
        for part in parts:
            visitor.visit(part)
        visitor.flush()
        if role == TRAINED_ROLE:
            loss.append((first, visitor.size))
        visitor.write(END + "\n")
    return {"formatted": "".join(visitor.out), "loss": loss, "attachments": visitor.attachments, "n_turns": len(turns)}


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_HOLDER = re.compile(r"<\|(image|audio|document|other):\d+\|>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders are no text."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        found.append((unescape(m[1]), unescape(_HOLDER.sub("", m[2]))))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return found


def trained_text(formatted: str, loss: list[tuple[int, int]]) -> str:
    return "".join(unescape(_HOLDER.sub("", formatted[a:b])) for a, b in loss)


@pandas_udf(FORMATTED)
def _format_column(turns: pd.Series) -> pd.DataFrame:
    made = [format_conversation([(t["role"], list(t["parts"]) if t["parts"] is not None else []) for t in conv]) for conv in turns]
    return pd.DataFrame(
        {
            "formatted": [m["formatted"] for m in made],
            "loss": [[{"first": a, "last": b} for a, b in m["loss"]] for m in made],
            "attachments": [[a._asdict() for a in m["attachments"]] for m in made],
            "n_turns": [m["n_turns"] for m in made],
        }
    )


def text_part(text: Column) -> Column:
    """A plain text as a list of one part; null is empty."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """conv_id, formatted, loss, attachments, n_turns: one row a conversation.

    ``parts`` is an array of part structs; without it the column text is one text part.

    A conversation is one training sample and one row, so its turns meet in one
    task. Turns go by (turn, role, text), null turns first; repeated rows are
    turns of their own; null roles and texts are empty. A row without a
    conversation id is a conversation of its own, of null id. An empty table
    gives no rows.
    """
    return gather_turns(rows, conv_col, turn_col, role_col, parts).select("conv_id", _format_column("turns").alias("f")).select("conv_id", "f.*")


def gather_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order."""
    parts = text_part(F.col("text")) if parts is None else parts
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.cast(f"array<{PART}>").alias("parts")).alias("t"),
    )
    return turns.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")


@pandas_udf(DIGESTS)
def _digests(chats: pd.DataFrame) -> pd.DataFrame:
    from hashlib import sha256

    digest = lambda text: sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    turns = [read_back(f) for f in chats["formatted"]]
    trained = [trained_text(f, [(s["first"], s["last"]) for s in spans]) for f, spans in zip(chats["formatted"], chats["loss"])]
    return pd.DataFrame(
        {
            "n_turns": [len(t) for t in turns],
            "turns_sha256": [digest("".join(f"{r}\n{t}\n" for r, t in conv)) for conv in turns],
            "loss_chars": [len(t) for t in trained],
            "loss_sha256": [digest(t) for t in trained],
            "formatted_chars": [len(f) for f in chats["formatted"]],
        }
    )


def chat_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """What the conversations of ``format_chats`` say when they are read back, one row each.

    Formatting and reading back run in one Python worker, batch by batch.
    """
    turns = gather_turns(rows, conv_col, turn_col, role_col, parts)
    return turns.select("conv_id", _digests(_format_column("turns")).alias("d")).select("conv_id", "d.*")
