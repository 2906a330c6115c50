"""Chat formatting from a declarative template, with a loss mask, and the reader that gets the turns back from the text.

A template names the parts of a turn, the roles whose text counts for the loss, and a finite-state machine over roles: the states that a state allows to follow. Conversations are streamed: rows
are dealt by conversation and sorted by turn, and each row needs the state of the machine alone, so a conversation of any length needs no memory.

Control strings inside texts are escaped by one more backslash between ``<`` and ``|``, in texts that have some already too, so the escape can be taken back and no text can hold a mark of the
template. Roles are escaped in the same way, and line ends in them are written ``%0A``.

Nulls: a null text or role is empty; rows without a conversation id are one conversation; a null turn comes first. Rows of one turn are ordered by role and text. Unknown roles
are errors of the turn order, but are formatted like others. Empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store


@dataclass(frozen=True)
class Template:
    """``opening`` and ``closing`` stand around each text; ``{role}`` is filled in. ``follow`` maps a state to the roles that may come next; after a turn its role is the state."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})

    def reader(self) -> str:
        """The pattern that takes one turn apart into role and text."""
        before, after = self.opening.split("{role}")
        return "(?s)^" + _literal(before) + r"(?P<role>[^\n]*)" + _literal(after) + "(?P<text>.*)" + _literal(self.closing) + "$"


CHATML = Template()
_SEGMENTS = "array<struct<text: string, loss: boolean>>"


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ \n" else "\\" + c for c in text)


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, pattern=r"<\\(\\*)\|", replacement=r"<\1|")


def escape_role(role: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(role, "%", "%25"), "\n", "%0A"))


def unescape_role(role: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(unescape(role), "%0A", "\n"), "%25", "%")


def format_turns(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, turn, segments, allowed`` for each row of ``conv_id, turn, role, text``, in the order in which the segments' texts make up the conversations: opening, text and closing, each with
    its loss flag, and whether the machine allows the turn after the one before it. A role that is not allowed sets the state all the same. Partitions hold whole conversations, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = (), template.start
        before, after = template.opening.split("{role}")
        for batch in batches:
            allowed = []
            for conv, role in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), strict=True):
                state, last = (state if last == (conv,) else template.start), (conv,)
                allowed.append(role in template.follow.get(state, ()))
                state = role
            n = batch.num_rows
            opening = pc.binary_join_element_wise(before, escape_role(batch["role"]), after, "")
            text, closing = escape(batch["text"]), pa.array([template.closing] * n, pa.string())
            loss = pc.is_in(batch["role"], pa.array(template.loss_roles, pa.string()))
            parts = pa.concat_arrays([opening, text, closing])
            flags = pa.concat_arrays([pa.array([False] * n), loss, pa.array([False] * n)])
            deal = pa.array(np.arange(3 * n).reshape(3, n).T.ravel())  # the three parts of each turn side by side
            segments = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.StructArray.from_arrays([parts.take(deal), flags.take(deal)], ["text", "loss"]))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], segments, pa.array(allowed, pa.bool_())], ["conv_id", "turn", "segments", "allowed"])

    store.bound_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segments {_SEGMENTS}, allowed boolean")


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation of ``format_turns``, from its segments alone: the turns are found again by the marks of the template and unescaped. ``n_turns``, ``turns_sha256`` (role, line end, text,
    line end of each turn), ``loss_chars`` and ``loss_sha256`` (code points and digest of the texts under the loss mask, unescaped), ``formatted_chars``, ``valid`` (no turn out of order and
    an accepted end) and ``first_error`` (the number of the first turn that is not allowed, from 0, else null). Texts go through the digests batch by batch."""

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, kind = (), None, None

        def made(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def row() -> list:
            n, turns, chars, loss, whole, role, wrong = now
            return [last[0], n, turns.hexdigest(), chars, loss.hexdigest(), whole, wrong is None and role in template.accept, wrong]

        for batch in batches:
            kind = batch["conv_id"].type
            segments = batch["segments"]
            at, flat = segments.offsets, segments.values
            text, masked = flat.field("text"), flat.field("loss")
            whole = pc.binary_join(pa.ListArray.from_arrays(at, text), "")  # the turn as it stands in the formatted text
            parts = pc.extract_regex(whole, pattern=template.reader())
            if parts.null_count:
                raise ValueError("a formatted turn can't be read back")
            role, said = unescape_role(parts.field("role")), unescape(parts.field("text"))
            spoken = pc.binary_join(pa.ListArray.from_arrays(at, pc.if_else(masked, unescape(text), "")), "")
            done = []
            for conv, r, t, s, chars, size, allowed in zip(batch["conv_id"].to_pylist(), role.to_pylist(), said.to_pylist(), spoken.to_pylist(), pc.utf8_length(spoken).to_pylist(), pc.utf8_length(whole).to_pylist(), batch["allowed"].to_pylist(), strict=True):
                if last != (conv,):
                    if last:
                        done.append(row())
                    last, now = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, "", None]
                now[1].update(f"{r}\n{t}\n".encode())
                now[3].update(s.encode())
                if now[6] is None and not allowed:
                    now[6] = now[0]
                now[0], now[2], now[4], now[5] = now[0] + 1, now[2] + chars, now[4] + size, r
            yield made(done)
        if last:
            yield made([row()])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_error long")
