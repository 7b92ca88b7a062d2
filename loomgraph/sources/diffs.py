"""Unified diffs to one row for each line, and untracked files as additions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "diff_id string, file_path string, is_new_file boolean, is_deleted boolean, hunk int, line_number int, content string, change_type string"
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: largest untracked file that is shown
MOST_BYTES = 1 << 20


def parse(diff_id: str, text: str) -> list[tuple]:
    """Rows of LINES. Added and context lines have their number in the new file, removed ones in the old; binary files are left out."""
    out, path, new, gone, hunk, old_at, new_at, old_left, new_left = [], None, False, False, -1, 0, 0, 0, 0
    for line in text.split("\n"):
        if old_left > 0 or new_left > 0:
            kind = {"+": "added", "-": "removed", " ": "context", "": "context"}.get(line[:1])
            if kind:
                at = old_at if kind == "removed" else new_at
                out.append((diff_id, path, new, gone, hunk, at, line[1:], kind))
                if kind != "added":
                    old_at, old_left = old_at + 1, old_left - 1
                if kind != "removed":
                    new_at, new_left = new_at + 1, new_left - 1
                continue
            if line.startswith("\\"):
                continue
        if line.startswith("diff --git "):
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            path, new, gone, hunk = (m[2] if m else None), False, False, -1
        elif line.startswith("new file mode"):
            new = True
        elif line.startswith("deleted file mode"):
            gone = True
        elif line.startswith("+++ ") and line[4:].strip() != "/dev/null":
            path = re.sub("^b/", "", line[4:].rstrip("\t"))
        elif line.startswith("--- ") and line[4:].strip() == "/dev/null":
            new = True
        elif line.startswith("+++ "):
            gone = True
        elif m := HUNK.match(line):
            hunk += 1
            old_at, old_left, new_at, new_left = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
    return out


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, text) to lines."""

    def run(frames):
        for pdf in frames:
            rows = [r for i, t in zip(pdf["diff_id"], pdf["text"]) for r in parse(i, t or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LINES.split(", ")])

    return diffs.select("diff_id", "text").mapInPandas(run, LINES)


def untracked(files: DataFrame) -> DataFrame:
    """Readable small text files of binaryFile rows (path, length, content) as added lines."""
    readable = (F.col("length") > 0) & (F.col("length") <= MOST_BYTES) & (F.locate("\u0000", F.decode(F.substring("content", 1, 8192), "ISO-8859-1")) == 0) & F.is_valid_utf8(F.col("content").cast("string"))
    lines = files.filter(readable).select("path", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\n")).alias("p", "content"))
    return lines.select(F.lit("untracked").alias("diff_id"), F.col("path").alias("file_path"), F.lit(True).alias("is_new_file"), F.lit(False).alias("is_deleted"), F.lit(0).alias("hunk"), (F.col("p") + 1).alias("line_number"), "content", F.lit("added").alias("change_type"))


def line_totals(lines: DataFrame) -> DataFrame:
    """(file_path, added, removed) and the old and new text of what changed, in order of lines."""
    kind = F.col("change_type")
    text = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == k, F.struct("hunk", "line_number", "content")))), lambda x: x["content"]), "\n")
    return lines.groupBy("file_path").agg(F.sum((kind == "added").cast("int")).alias("added"), F.sum((kind == "removed").cast("int")).alias("removed"), text("removed").alias("old_text"), text("added").alias("new_text"))
