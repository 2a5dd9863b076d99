from __future__ import annotations

import hashlib
import io
import os
import random

import pyarrow.fs as pafs
import zstandard
from compare import duck, run
from conftest_llm import DATA

from tapeline.llm import warc
from tapeline.llm.common import ORACLES
from tapeline.session import shared_dir


def by_hand(rows):
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        revisit = len(p) >= 1000 and i is not None and i < max(same)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op7", warc._op7, ORACLES["op7_warc"], DATA)
    assert ok and n, message


def test_odd_pages(spark, frame):
    rng = random.Random(3)
    bodies = [None, "", "short", "x" * 999, "y" * 1000, "é" * 500, "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 40, "\r\n\r\n" * 400, "z" * 3_000_000,
              "".join(rng.choice("abc \n") for _ in range(5000))]
    urls = [None, "", "http://a/b c\r\nX: y", "http://ü/é?q=1"]
    rows = [(i, urls[i % 4], bodies[i % len(bodies)]) for i in range(60)] + [(None, None, "y" * 1000), (None, "u", None), (7, "u", "tie"), (7, "u", "tie"), (90, "u", "q" * 1200), (90, "u", "q" * 1200)]
    pages = frame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, kind string")
    folder = shared_dir(spark, "warc")
    index = warc.archive(pages, folder)
    assert sorted((tuple(r) for r in warc.report(index, folder).collect()), key=str) == by_hand(rows)
    # each file is plain Zstandard to other readers and its records follow one another
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    names, found = {r.bundle for r in index.collect()}, 0
    for name in names:
        with fs.open_input_file(os.path.join(root, name)) as f:
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
        at = 0
        while at < len(data):
            head, block, at = warc.parse(data, at)
            found += 1
            assert head["WARC-Type"] == "response" or not block
    assert found == len(rows)


def test_repeated_ids_with_other_bodies(spark, frame):
    """Both revisits of page 1 lead to page 2, each to the body it had."""
    a, b = "a" * 1500, "b" * 2500
    rows = [(1, "u", a), (2, "u", a), (2, "u", b), (1, "u", b), (2, "u", a), (3, "u", "tiny")]
    folder = shared_dir(spark, "warc")
    index = warc.archive(frame(rows, "page_id long, url string, html string"), folder)
    assert sorted((tuple(r) for r in warc.report(index, folder).collect()), key=str) == by_hand(rows)
    assert len({warc.record_id(i, hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}) == 5


def test_paths(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    fs, root = warc._open(f"file:{tmp_path}")
    assert isinstance(fs, pafs.LocalFileSystem) and root == str(tmp_path)
    assert warc._open("file:///a/b")[1] == "/a/b"


def test_one_frame_is_read_alone():
    bundle = warc.Bundle()
    records = [warc.record("response", i, f"http://x/{i}", os.urandom(40_000), "d", None) for i in range(40)]
    places = [bundle.add(r) for r in records]
    data = bundle.close()
    frames = warc.seek_table(io.BytesIO(data), len(data))
    assert len(frames) > 3 and len({f for f, _ in places}) == len(frames)
    for r, (frame, offset) in zip(records, places):
        at, packed, whole = frames[frame]
        assert zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=whole)[offset:offset + len(r)] == r


def test_empty(spark, frame):
    folder = shared_dir(spark, "warc")
    assert warc.report(warc.archive(frame([], "page_id long, url string, html string"), folder), folder).collect() == []
