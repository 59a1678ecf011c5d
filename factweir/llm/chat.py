"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are cut into turn-aligned spans by prefix sums of their tokens: a
window holds the system turn, a limited history of turns repeated from before its span, and as many new turns
as its token budget allows. The loss covers the assistant texts of the span; everything repeated is masked,
so over all windows each assistant text is a target once.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside texts and roles every `<|`, also with
backslashes between the two, gets one more backslash; newlines of a role are escaped as well. Both are undone
when reading back.

Rows are sorted by conversation and turn within partitions and streamed, so a task holds one window's turns,
however long a conversation is.

Defined results: null texts and roles are empty; a null conv_id is a conversation; turns are ordered by
turn (nulls first), role and text, and repeated rows are turns of their own; a turn that does not fit is a
window of its own and over budget, never cut or dropped; only a first turn with role `system` is retained.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import pick, prepare
from factweir.llm.tokens import tokenizer

START, END = "<|im_start|>", "<|im_end|>"

WINDOW_SCHEMA = "conv_id long, window int, n_context int, n_turns int, n_tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"

_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("window", pa.int32()), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()),
        ("over_budget", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted window; start and end frame the escaped text."""
    out, at = [], 0
    while at < len(text):
        head = text.index("\n", at)
        end = text.index(END, head)
        out.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), head + 1, end))
        at = end + len(END) + 1
    return out


class _Conversation:
    """Windows of one conversation as its turns come in."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.context: list[tuple[str, str, int]] = []  # of the open window
        self.span: list[tuple[str, str, int]] = []
        self.turns = self.window = 0
        self.used = 0

    def _context(self) -> list[tuple[str, str, int]]:
        """The system turn, then the latest turns before the next span, up to the history's tokens."""
        last, room = [], self.history
        for turn in reversed(self.context + self.span):
            if turn is self.system or turn[2] > room:
                break
            last.append(turn)
            room -= turn[2]
        return ([self.system] if self.system else []) + last[::-1]

    def add(self, turn: tuple[str, str, int]) -> Iterator[dict]:
        if self.turns == 0 and turn[0] == "system":
            self.system = turn
        if self.span and self.used + turn[2] > self.budget:
            yield self.close()
            context = self._context()
            while sum(t[2] for t in context) + turn[2] > self.budget and len(context) > (1 if self.system else 0):
                context.pop(1 if self.system else 0)
            self.context, self.span, self.window = context, [], self.window + 1
            self.used = sum(t[2] for t in context)
        self.span.append(turn)
        self.used += turn[2]
        self.turns += 1

    def close(self) -> dict:
        text, at, loss = [], 0, []
        for i, (role, body, _) in enumerate(chain(self.context, self.span)):
            head, shown = f"{START}{escape_role(role)}\n", escape(body)
            if i >= len(self.context) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(shown)})
            text.append(f"{head}{shown}{END}\n")
            at += len(text[-1])
        return {
            "conv_id": self.conv_id, "window": self.window, "n_context": len(self.context), "n_turns": len(self.span), "n_tokens": self.used,
            "over_budget": self.used > self.budget, "text": "".join(text), "loss": loss,
        }


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """turns(conv_id, turn, role, text) to windows (WINDOW_SCHEMA): `text` with `loss` spans in code points.

    The first n_context turns of a window are repeated, the other n_turns are its span. A turn counts the
    tokens of its text and two for the marks.
    """
    prepare(turns.sparkSession)
    rows = pick(turns, "conv_id", "turn", "role", "text").fillna("", ["role", "text"])
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, now = tokenizer(tokenizer_path), None
        for b in batches:
            out: list[dict] = []
            ids, roles, texts = (b.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, role, text, found in zip(ids, roles, texts, tok.encode_all(texts), strict=True):
                if now is None or now.conv_id != conv_id:
                    out += [now.close()] if now else []
                    now = _Conversation(conv_id, budget, history)
                out += now.add((role, text, len(found) + 2))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], schema=_ARROW)

    return rows.mapInArrow(run, WINDOW_SCHEMA)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say when read back: turns and loss digests, and sizes.

    windows must come straight from `format_windows`, whose partitions hold a conversation's windows together
    and in order. The digests are updated window by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def done() -> dict:
            return {k: v.hexdigest() if k.endswith("sha256") else v for k, v in now.items()}

        for b in batches:
            out = []
            for w in b.to_pylist():
                if now is None or now["conv_id"] != w["conv_id"]:
                    out += [done()] if now else []
                    now = {"conv_id": w["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
                for role, text, _, _ in read_turns(w["text"])[w["n_context"] :]:
                    now["n_turns"] += 1
                    now["turns_sha256"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    now["loss_chars"] += len(text)
                    now["loss_sha256"].update(text.encode("utf-8", "surrogatepass"))
                now["formatted_chars"] += len(w["text"])
                now["n_windows"] += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
    schema = pa.schema(kinds)
    return windows.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds))
