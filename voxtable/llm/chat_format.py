"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, turn by turn, and encoded once, with the character span of each token. The spans of
the turns whose role is trained on are sorted, as the tokens are, so the tokens of a turn are found by binary search;
they make the loss mask. A token that reaches over the border of a turn counts with its part inside.

Template: ``### role: text</turn>`` and a line break per turn. A backslash, ``###`` or ``</turn>`` inside a text gets a
backslash in front, in a role a colon as well, so the rendering can be read back.

Defined cases: a null text or role is empty; turns go by turn number (null first), then role and text; a null
conversation id is one conversation; repeated rows are turns of their own; an empty table gives no rows; other columns
are not read. A conversation is one row, so it must fit into a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, COLON, CLOSE, ESCAPE = "### ", ": ", "</turn>\n", "\\"
LOSS_ROLES = ("assistant",)
_in_text = re.compile(r"\\|###|</turn>")
_in_role = re.compile(r"\\|###|</turn>|:")
_escaped = re.compile(r"\\(\\|###|</turn>|:)")
_marks = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n|: |### ")


def escape(text: str, pattern: re.Pattern = _in_text) -> str:
    return pattern.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the spans, in order, of the texts trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role, _in_role) + COLON, escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    turns, role, start, inside = [], None, 0, ""
    for m in _marks.finditer(formatted):
        if m[0] == HEAD and inside == "":
            start, inside = m.end(), "role"
        elif m[0] == COLON and inside == "role":
            role, start, inside = unescape(formatted[start:m.start()]), m.end(), "text"
        elif m[0] == CLOSE and inside == "text":
            turns.append((role, unescape(formatted[start:m.start()])))
            inside = ""
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask of tokens with ascending (begin, end) offsets, and the characters under it within each turn's span."""
    flags, covered = np.zeros(len(offsets), np.int8), []
    begins, ends = (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.zeros(0, int),) * 2
    for a, b in spans:
        first, after = np.searchsorted(ends, a, side="right"), np.searchsorted(begins, b, side="left")
        if a < b and first < after:
            flags[first:after] = 1
            covered.append((max(a, int(begins[first])), min(b, int(ends[after - 1]))))
    return flags, covered


def format_conversations(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per conversation: the id, n_turns, formatted, ids, loss_mask (per token), loss_spans (characters).

    tokenizer: path of a tokenizers file with offsets, readable by every executor. Strings of its special tokens in a
    text are ordinary text.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("id", "turns.role", "turns.text")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.no_truncation()
        encoder.no_padding()
        encoder.encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows = []
                for roles, texts in zip(part["role"].to_pylist(), part["text"].to_pylist(), strict=True):
                    formatted, spans = render(list(zip(roles, texts, strict=True)), loss_roles)
                    encoded = encoder.encode(formatted, add_special_tokens=False)
                    flags, covered = mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
                    rows.append((len(roles), formatted, encoded.ids, flags.tolist(), [{"first": a, "after": b} for a, b in covered]))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                                                 ["id", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(fn, f"id {kind}, n_turns long, formatted string, ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<first:int,after:int>>"
                            ).withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per rendered conversation: the id, roles, texts, loss_texts (unescaped), read from the rendering alone."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns.append(parse(text))
                losses.append([unescape(text[s["first"]:s["after"]]) for s in spans])
            many = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([[r for r, _ in t] for t in turns], many), pa.array([[x for _, x in t] for t in turns], many),
                                              pa.array(losses, many), batch["formatted"]], ["id", "roles", "texts", "loss_texts", "formatted"])

    return (formatted.select(F.col(id_col).alias("id"), "formatted", "loss_spans")
            .mapInArrow(fn, f"id {kind}, roles array<string>, texts array<string>, loss_texts array<string>, formatted string").withColumnRenamed("id", id_col))
