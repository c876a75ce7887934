"""Digests of file sets and the keyed table that streams write."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from rankspark.sources import files as W
from rankspark.streaming import tails

EVENT = "user_id bigint, event_id bigint, value double"


def test_digest_of_named_files(spark, tmp_path):
    content = {"a": {"one.py": b"x = 1\n", "two.py": b"\xff\x00", "other.txt": b"!"}, "b": {"two.py": b"", "one.py": b"y"}, "c": {"other.txt": b"?"}}
    for folder, files in content.items():
        (tmp_path / folder).mkdir()
        for name, body in files.items():
            (tmp_path / folder / name).write_bytes(body)
    names = ["two.py", "one.py", "absent.py"]
    got = {os.path.basename(r["folder"]): (r["sha256"], r["files"]) for r in W.set_digest(W.read_files(spark, str(tmp_path)), names).collect()}
    want = {}
    for folder, files in content.items():
        h = hashlib.sha256()
        for name in names:
            if files.get(name):     # the reader passes over empty files
                h.update(name.encode() + files[name])
        want[folder] = (h.hexdigest(), sum(bool(files.get(n)) for n in names))
    assert got == want


def _feed(path, batches):
    path.mkdir()
    for i, rows in enumerate(batches):
        p = path / f"{i}.json"
        p.write_text("".join(json.dumps(dict(zip(("user_id", "event_id", "value"), r))) + "\n" for r in rows))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))     # files are taken in order of time


def _bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/*.parquet"))


def _latest(spark, path):
    return tails.latest_state(tails.tail_jsonl(spark, str(path), EVENT, max_files=1), "user_id", "event_id", ["value"])


def test_a_batch_writes_the_keys_it_changed(spark, tmp_path):
    many = [(u, u, float(u)) for u in range(3000)]
    _feed(tmp_path / "log", [many] + [[(u, 5000 + i, -1.0) for u in (i, i + 1)] for i in range(4)])
    table = tails.upsert(_latest(spark, tmp_path / "log"), ["user_id"], "state", compact_every=100)
    sizes = [_bytes(f"{table.path}/delta/epoch={e}") for e in range(5)]
    counts = [spark.read.parquet(f"{table.path}/delta/epoch={e}").count() for e in range(5)]
    assert counts == [3000, 2, 2, 2, 2]
    assert max(sizes[1:]) < sizes[0] / 3
    got = {r["user_id"]: (r["event_id"], r["value"]) for r in table.read().collect()}
    assert len(got) == 3000 and got[1] == (5001, -1.0) and got[4] == (5003, -1.0) and got[77] == (77, 77.0)


def test_folding_keeps_the_rows_and_bounds_the_folders(spark, tmp_path):
    batches = [[(u, 100 * b + u, float(b)) for u in range(b, b + 3)] + [(None, 100 * b, float(b))] for b in range(7)]
    _feed(tmp_path / "log", batches)
    table = tails.upsert(_latest(spark, tmp_path / "log"), ["user_id"], "state", compact_every=2)
    want = {r[0]: r[1:] for b in batches for r in b}
    as_dict = lambda df: {r["user_id"]: (r["event_id"], r["value"]) for r in df.collect()}
    assert as_dict(table.read()) == want
    assert table._epochs("base") == [3, 5] and table._epochs("delta") == [4, 5, 6]
    table.compact(5)        # a batch that runs again
    assert as_dict(table.read()) == want


def test_keyed_table_of_an_empty_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    table = tails.upsert(_latest(spark, tmp_path / "log"), ["user_id"], "state")
    assert table.read().count() == 0 and table.read().columns == ["user_id", "event_id", "value"]


def test_state_on_disk_is_bounded_by_the_horizon(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [[("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:10")], [("a", "2024-01-01 00:30:00")], [("c", "2024-01-01 06:00:00")],
             [("d", "2024-01-01 06:00:00")], [("a", "2024-01-01 06:10:00"), ("late", "2024-01-01 00:00:00")]]
    for i, rows in enumerate(lines):
        p = folder / f"{i}.json"
        p.write_text("".join(json.dumps({"text": t, "at": at}) + "\n" for t, at in rows))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with tails.state_on_disk(spark):
        stream = tails.tail_jsonl(spark, str(folder), "text string, at timestamp", max_files=1)
        out = tails.drain(tails.first_seen(stream, "text", "at", "1 hour"), "append", "within")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    # the copy of "a" within the hour goes, the one six hours later stays; what comes behind the watermark is dropped
    assert sorted((r["text"], r["h"]) for r in out.select("text", F.hour("at").alias("h")).collect()) == [("a", 0), ("a", 6), ("b", 0), ("c", 6), ("d", 6)]


def test_state_on_disk_restores_the_setting(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    with pytest.raises(RuntimeError):
        with tails.state_on_disk(spark):
            raise RuntimeError
    assert spark.conf.get(name, None) != tails.ROCKSDB
