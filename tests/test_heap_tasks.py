"""Recordings: lines keep their scan tasks when they are numbered, and more lines
mean more tasks of sorted rows, not larger ones."""

import os
import re

from pyspark.sql import functions as F

from loctrack import sources as A
from loctrack.operators import timeseries as H


def _lines(blocks: int, shift: int) -> list[str]:
    """Blocks of odd forms: nested braces, repeated fields, no braces, never closed,
    longer than some chunks, without a field; text before the first and between."""
    out = ["before", "  heapUsed = 1.2.3 MB", "}", "startTime = 00:00:00.0"]
    for i in range(blocks):
        time, used = f"  startTime = 10:{i // 60:02d}:{i % 60:02d}.000 (2026-01-18)", f"  heapUsed = {i + shift}.5 {['MB', 'GB', 'KB', ''][i % 4]}"
        k = i % 7
        out += {0: ["jdk.GCHeapSummary {", time, "  heapSpace = {", "    start = 0x1", "  }", used, "}", "", "other {", "}"],
                1: ["jdk.GCHeapSummary {", time, used, "  heapUsed = 7 MB", "}", "  heapUsed = 8 MB"],
                2: ["jdk.GCHeapSummary", time, used],
                3: ["jdk.GCHeapSummary {", time, used, "text"],
                4: ["jdk.GCHeapSummary {", time, *["  gcId = 1"] * 20, *["  a = {", "  }"] * 8, used, "}"],
                5: ["jdk.GCHeapSummary {", used, "}"],
                6: ["  jdk.GCHeapSummary { ", used, time, "} {", "}"]}[k]
    return out + ["jdk.GCHeapSummary {", "  startTime = 11:00:00.000", "  heapUsed = 9 MB"]


def _parsed(lines: list[str]) -> list[tuple]:
    """One line after the other: (sample number, time, MB) of the blocks with both."""
    out, n, block, depth, ended = [], 0, None, 0, True
    for line in map(str.strip, lines):
        if line.startswith("jdk.GCHeapSummary"):
            if not ended and len(block) == 2:
                out.append((n, block["t"], block["mb"]))
            n, block, depth, ended = n + 1, {}, 0, False
        if ended:
            continue
        depth += line.count("{") - line.count("}")
        if m := re.search(r"startTime = (.+?)(?:\s*\(|$)", line):
            block["t"] = m[1].strip()
        if m := re.search(r"heapUsed = ([\d.]+)\s*([A-Z]+)?", line):
            block["mb"] = float(m[1]) * {"MB": 1, "GB": 1024, "KB": 1 / 1024}.get(m[2], 1 / (1024 * 1024))
        if depth == 0 and block:
            ended = True
            if len(block) == 2:
                out.append((n, block["t"], block["mb"]))
    return out


def _written(folder: str) -> dict[str, list[str]]:
    os.makedirs(folder)
    files = {"a.txt": _lines(150, 0), "b.txt": _lines(60, 1000), "c.txt": _lines(0, 0)}
    for name, lines in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    return files


def test_lines_stay_in_their_scan_tasks(spark, tmpdir_path):
    files = _written(f"{tmpdir_path}/rec")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "500")
        lines = A.read_heap_recordings(spark, f"{tmpdir_path}/rec")
        rows = lines.withColumn("task", F.spark_partition_id()).collect()
        n_splits = spark.read.text(f"{tmpdir_path}/rec").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((os.path.basename(r.recording), r.line_no, r.line) for r in rows)
    assert got == sorted((name, i, x) for name, some in files.items() for i, x in enumerate(some))
    assert n_splits > 5 and len({r.task for r in rows}) == n_splits


def test_heap_samples_in_more_tasks(spark, tmpdir_path, monkeypatch):
    files = _written(f"{tmpdir_path}/rec")
    monkeypatch.setattr(H, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(H, "CHUNK_LINES", 8, raising=False)
    rows = H.heap_samples(A.read_heap_recordings(spark, f"{tmpdir_path}/rec")).withColumn("task", F.spark_partition_id()).collect()
    got = sorted((os.path.basename(r.recording), r.sample_no, r.time_str, r.heap_mb) for r in rows)
    assert got == sorted((name, *x) for name, some in files.items() for x in _parsed(some))
    sizes = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(sizes) > 8 and max(sizes) < len(rows) / 4
