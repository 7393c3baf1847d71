"""Chat formatting: conversations rendered by a compiled template, and read back.

``render`` returns one row per conversation with its formatted text and the spans under the loss
mask. Control strings inside roles and texts are broken up by a backslash after their first
character, and backslashes are doubled, so that no text can open or close a turn and ``unescape``
restores it exactly.

Rows are shuffled by conversation and sorted by turn in Spark (which spills); Python sees a sorted
stream and holds one conversation at a time.

Defined results
---------------
* Null text or role counts as empty. Null conv_id is a conversation of its own; a null turn comes first.
* Rows that tie on the turn are ordered by role, then text; repeated rows are all rendered.
* Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.templates import compile_template

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that common chat formats read as control: fixed values.
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
TEMPLATE = (
    "{% for m in messages %}" + OPEN + "{{ m.role|escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    + CLOSE + "\n{% endfor %}"
)
RENDERED = "conv_id long, formatted string, loss_spans array<struct<start:int,stop:int>>"


def escaper(controls: Sequence[str] = CONTROLS) -> Callable[[str], str]:
    found = re.compile("(?=" + "|".join(map(re.escape, controls)) + ")(.)", re.S)
    return lambda text: found.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a text that the default template has made."""
    role, at = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S), 0
    while at < len(formatted):
        head = role.match(formatted, at + len(OPEN))
        if not formatted.startswith(OPEN, at) or not head or (end := formatted.find(CLOSE + "\n", head.end())) < 0:
            raise ValueError(f"no turn at {at}")
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(CLOSE) + 1


def format_conversation(template: Callable, messages: Iterator[dict]) -> tuple[str, list[dict]]:
    """The formatted text, and the spans (code points) that the generation markers cover."""
    pieces, spans, at = [], [], 0
    for text, generated in template(messages=messages):
        if generated and text:
            if spans and spans[-1]["stop"] == at:
                spans[-1]["stop"] = at + len(text)
            else:
                spans.append({"start": at, "stop": at + len(text)})
        pieces.append(text)
        at += len(text)
    return "".join(pieces), spans


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
    return groupby(rows, key=lambda r: (r[0], r[1]))


def render(conversations: DataFrame, template: str = TEMPLATE, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape = escaper(controls)
        filters = {"escape": escape, "escape_line": lambda x: escape(x).replace("\n", "\\\n")}
        compiled, rows, held = compile_template(template, filters), [], 0
        for (conv_id, missing), group in _conversations(batches):
            text, spans = format_conversation(compiled, ({"role": r[2], "text": r[3]} for r in group))
            rows.append((None if missing else conv_id, text, spans))
            held += len(text)
            if held > 4 << 20 or len(rows) >= 5000:
                yield _frame(rows)
                rows, held = [], 0
        yield _frame(rows)

    empty = F.lit("")
    return (
        conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("missing"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
        .repartition("id", "missing")
        .sortWithinPartitions("id", "missing", "turn", "role", "text")
        .select("id", "missing", "role", "text")
        .mapInPandas(run, RENDERED)
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], dtype="Int64"), "formatted": [r[1] for r in rows], "loss_spans": [r[2] for r in rows]})


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(rendered: DataFrame) -> DataFrame:
    """What reading the formatted texts back gives: turns and the text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv_id, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"]):
                turns, n = hashlib.sha256(), 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                out.append((conv_id, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")])
            frame["conv_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["conv_id"]], dtype="Int64")
            yield frame

    return rendered.mapInPandas(run, DIGEST)
