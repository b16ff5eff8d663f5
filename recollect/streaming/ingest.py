"""Streams of session logs: delta slices by cursor, and merging of extracted events batch by batch.

Snapshots of growing logs come in as rows (project_id, session_id, text); keyed state holds
each session's cursor, so a batch carries only what is new.  Batches are merged once: the
batch's evidence is remembered, and a replayed batch finds it there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators.merge import merge_sets, unmerged
from recollect.sources.transcripts import ANCHOR_LINES, OVERLAP_LINES

OUTPUT = "project_id string, session_id string, is_delta boolean, stored string, extracted string, new_line_count long"
STATE = "line_count long, anchor string"


def _anchor(lines: list[str], up_to: int) -> str:
    return hashlib.sha256("\n".join(lines[max(0, up_to - ANCHOR_LINES) : up_to]).encode()).hexdigest()


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The slices of one session's snapshots, the shortest first; a snapshot that brings nothing new gives none."""
    count, anchor = state.get if state.exists else (0, "")
    out = []
    texts = sorted((t for b in batches for t in b["text"].dropna()), key=lambda t: (t.count("\n"), t))
    for text in texts:
        lines = [x for x in text.splitlines() if x.strip()]
        grown = count > 0 and len(lines) >= count and _anchor(lines, count) == anchor
        if grown and len(lines) == count:
            continue
        start = count if grown else 0
        out.append((*key, grown, "\n".join(lines[start:]), "\n".join(lines[max(0, start - OVERLAP_LINES) if grown else 0 :]), len(lines)))
        count, anchor = len(lines), _anchor(lines, len(lines))
        state.update((count, anchor))
    if out:
        yield pd.DataFrame(out, columns=["project_id", "session_id", "is_delta", "stored", "extracted", "new_line_count"])


def slices(snapshots: DataFrame) -> DataFrame:
    """What is new of each session, by its cursor: a line count and a hash per session are kept."""
    keyed = snapshots.select("project_id", "session_id", "text").groupBy("project_id", "session_id")
    return keyed.applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


class MemorySink:
    """foreachBatch target: a versioned state table, each batch merged into the last version.

    A version is written whole before the pointer to it moves, so a lost driver or executor
    leaves the old one; a batch whose evidence the state holds is left out.
    """

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder.rstrip("/"), schema

    def current(self, spark) -> DataFrame:
        versions = self._versions(spark)
        return spark.read.schema(self.schema).parquet(f"{self.folder}/v={versions[-1]:08d}") if versions else spark.createDataFrame([], self.schema)

    def _versions(self, spark) -> list[int]:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("v="))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = self._versions(spark)
        if batch_id in versions:
            return
        state = self.current(spark)
        seen = state.where("evidence_id is not null").select(F.col("evidence_id").alias("raw_evidence_id"))
        merge_sets(state, unmerged(batch, seen)).write.mode("overwrite").parquet(f"{self.folder}/v={batch_id:08d}")


def windowed_activity(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; in a stream, what is later than `late` is left out."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
