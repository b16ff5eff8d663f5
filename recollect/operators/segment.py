"""Sentences of transcripts.

One Arrow function turns a transcript into its sentences: fenced code is one sentence, list
items and `Label: value` lines stand alone, other lines are joined and split where a
sentence ends before a capital.  Offsets are in characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.statements import LABEL_FIRST

# Abbreviations and patterns.
ABBREVIATIONS = frozenset(
    "e.g. i.e. vs. etc. mr. mrs. ms. dr. prof. sr. jr. inc. ltd. co. fig. approx. dept. est. avg. max. min. no. vol.".split()
)
_CODE = re.compile(r"```.*?```", re.DOTALL)
_SPEAKER = re.compile(r"^(Human|User|Assistant|Claude)\s*:\s*", re.MULTILINE | re.IGNORECASE)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+\.)\s+(?=\S)")
_LABEL = re.compile(r"^[A-Z][A-Za-z0-9 _/()\-]{0,48}:\s+\S")
_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")

SENTENCE = pa.struct(
    [("idx", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("is_code", pa.bool_()), ("list_item", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]
)


def _speakers(text: str):
    """(role, start, end) of every speaker's part; before the first marker, the user speaks."""
    marks = list(_SPEAKER.finditer(text))
    edges = [m.start() for m in marks] + [len(text)]
    if edges[0] > 0:
        yield "user", 0, edges[0]
    for mark, end in zip(marks, edges[1:]):
        yield ("assistant" if mark.group(1).lower() in ("assistant", "claude") else "user"), mark.end(), end


def _is_fact(line: str) -> bool:
    if not _LABEL.match(line) or line.endswith(","):
        return False
    label = line.split(":", 1)[0].split()
    return len(label) <= 4 and label[0].lower() not in LABEL_FIRST


def _prose(text: str, start: int):
    """(text, start, end) of the sentences of joined lines that begin at `start`."""
    at = 0
    for m in _END.finditer(text):
        words = text[at : m.start()].split()
        if words and (words[-1].lower() in ABBREVIATIONS or words[-1].lower() + "." in ABBREVIATIONS):
            continue
        yield text[at : m.start()].strip(), start + at, start + m.start()
        at = m.end()
    if text[at:].strip():
        yield text[at:].strip(), start + at, start + len(text)


def _lines(text: str, base: int):
    """(text, start, end, list_item) of a speaker's part without code."""
    held: list[str] = []
    began = at = base
    for line in text.split("\n"):
        stripped, end = line.strip(), at + len(line)
        item = _ITEM.match(line)
        if not stripped or item or _is_fact(stripped):
            if held:
                yield from ((*s, False) for s in _prose(" ".join(held), began))
                held = []
            if item:
                yield line[item.end() :].strip(), at, end, True
            elif stripped:
                yield from ((*s, False) for s in _prose(stripped, at))
        else:
            if not held:
                began = at
            held.append(stripped)
        at = end + 1
    if held:
        yield from ((*s, False) for s in _prose(" ".join(held), began))


def sentences(text: str) -> list[dict]:
    code = [m.span() for m in _CODE.finditer(text)]
    out: list[dict] = []

    def add(role, said, start, end, is_code=False, list_item=False):
        if said:
            out.append({"idx": len(out), "role": role, "text": said, "is_code": is_code, "list_item": list_item, "start": start, "end": end})

    for role, low, high in _speakers(text):
        at = low
        for a, b in [s for s in code if low <= s[0] and s[1] <= high]:
            for said, start, end, item in _lines(text[at:a], at):
                add(role, said, start, end, list_item=item)
            add(role, text[a:b].strip(), a, b, is_code=True)
            at = b
        for said, start, end, item in _lines(text[at:high], at):
            add(role, said, start, end, list_item=item)
    return out


def segment(transcripts: DataFrame, keys: tuple[str, ...] = ("session_id",), text_col: str = "transcript", most_bytes: int | None = None) -> DataFrame:
    """keys, idx, role, text, is_code, list_item, list_group, start, end: one row per sentence.

    Transcripts are read whole.  If most_bytes is given, only the end of a longer one is, and
    U+FFFD stands for the bytes of a character that is cut.  Contiguous list items share a group.
    """
    text = F.col(text_col)
    if most_bytes is not None:
        tail = F.substring(F.encode(text, "UTF-8"), F.lit(-most_bytes), F.lit(most_bytes)).cast("string")
        text = F.when(F.octet_length(text) > most_bytes, F.make_valid_utf8(tail)).otherwise(text)
    chosen = transcripts.select(*keys, F.coalesce(text, F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            found = pa.array([sentences(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(SENTENCE))
            yield pa.record_batch([*batch.columns[:-1], found], names=[*keys, "s"])

    made = chosen.mapInArrow(run, f"{schema}, s array<struct<idx int, role string, text string, is_code boolean, list_item boolean, start int, end int>>")
    each = made.select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    return list_groups(each, keys)


def list_groups(each: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """sentences with list_group: runs of list items counted from 1, -1 elsewhere."""
    order = Window.partitionBy(*keys).orderBy("idx")
    begins = F.col("list_item") & ~F.coalesce(F.lag("list_item").over(order), F.lit(False))
    run = F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("list_group", F.when(F.col("list_item"), run).otherwise(-1))
