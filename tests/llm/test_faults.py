"""Damaged archives, ids that are no numbers, clashing columns and texts with very many findings."""

from __future__ import annotations

import glob
import gzip
import os
import subprocess
import sys
import time

import pytest

from fleetspan.llm import archive, blobs, loading, shards
from fleetspan.llm.store import unused


def test_unused_names():
    assert unused(["_Key", "x"], "_key", "_size", "_size") == ["__key", "_size", "__size"]


def test_damaged_segments_are_told(spark, tmp_path):
    long = "äöü depot " * 900
    pages = spark.createDataFrame([(1, "u", long), (2, "u", "short"), (3, "u", long), (4, None, None), (5, "u", "x" * 5000)], "page_id long, url string, html string")
    folder = str(tmp_path / "a")
    run = archive.write_archives(pages, folder, chunk_bytes=1000)
    read = lambda: {r["page_id"]: (r["payload_bytes"], r["intact"]) for r in archive.read_archives(spark, folder, run).collect()}
    assert read() == {1: (len(long.encode()), True), 2: (5, True), 3: (len(long.encode()), True), 4: (0, True), 5: (5000, True)}
    changed = 0
    for f in glob.glob(f"{folder}/*.gz"):  # three bytes of a middle segment, the length as before
        data = gzip.open(f).read()
        at = data.find(b"WARC-Segment-Number: 4")
        at = data.find(b"depot", at) if at >= 0 else -1
        if at >= 0 and b"X-Page-ID: 1\r" in data:
            with gzip.open(f, "wb") as out:
                out.write(data[:at] + b"DEP" + data[at + 3 :])
            changed += 1
            crc = os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc")
            if os.path.exists(crc):
                os.remove(crc)
    assert changed == 1
    assert {k: v[1] for k, v in read().items()} == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_chunks_are_whole_characters(spark):
    texts = ["", "é" * 7, "a日b本", "\U0001f600" * 3, None]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for size in (1, 2, 5, 100):
        rows = archive.chunk_table(pages, chunk_bytes=size).orderBy("page_id", "chunk").collect()
        for i, t in enumerate(texts):
            mine = [r for r in rows if r["page_id"] == i]
            assert "".join(r["part"] for r in mine) == (t or "") and [r["chunk"] for r in mine] == list(range(mine[0]["chunks"]))
            assert all(r["part_bytes"] <= max(size, 4) for r in mine)


def test_project_ids_and_clashing_columns(spark):
    rows = [(f"ORD-{i:09d}", 10 + i % 5, 1, 2, 3, 4, 5, 6) for i in range(200)] + [(None, 3, 1, 2, 3, 4, 5, 6), ("none", 3, 1, 2, 3, 4, 5, 6)]
    columns = "order_id string, package_bytes long, _key int, _size int, _tie int, _run int, _first int, _n int"
    got = shards.balanced_shards(spark.createDataFrame(rows, columns), shards=5).collect()
    names = [c.split()[0] for c in columns.split(", ")]
    assert sorted(str(tuple(r[c] for c in names)) for r in got) == sorted(map(str, rows))
    order = [r["shard"] for r in sorted(got, key=lambda r: (r["order_id"] or "").replace("none", ""))]
    assert order == sorted(order) and set(order) == set(range(5))
    rows = [(f"ORD-{i}", 1 + i * 7 % 90, 5, 99, True) for i in range(300)]
    out = loading.load_orders(spark.createDataFrame(rows, "order_id string, items_count int, _part int, _row int, _open boolean"), capacity=100).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(rows)
    texts = spark.createDataFrame([("CUS-1", "one two"), ("CUS-2", None)], "customer_id string, address string")
    import public_tokenizers

    pieces = loading.token_pieces(texts, "customer_id", "address", public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert {r["key"] for r in pieces} == {"CUS-1", "CUS-2"}


def test_very_many_findings_in_one_text(spark):
    text = "x token=abcdef " * 20_000
    began = time.time()
    found, _ = blobs.scan_versions(spark.createDataFrame([("a", text)], "path string, text string"))
    row = found.first()
    assert time.time() - began < 60 and [(s["start"], s["end"]) for s in row["assign"]] == [(15 * k + 2, 15 * k + 14) for k in range(20_000)]


def test_queries_need_no_package_on_the_workers(tmp_path):
    """All queries run from an empty folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from fleetspan.session import local_session
from fleetspan.llm import queries
spark = local_session(2, 2, "3g", **{{"spark.ui.showConsoleProgress": "false"}})
for name in {["op1_repetition", "op5_neighbour_votes", "op6_leaked_items", "op8_best_fit", "op10_surrogates", "op11_dialogue_repair", "op12_byte_bpe", "op13_token_crosswalk"]!r}:
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
