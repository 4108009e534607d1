"""Archives: every byte comes back, one member per record, by its offset."""

import gzip
import random
import zlib

import pytest

from signalmill.llm import warc
from signalmill.session import scratch_path


def run(spark, pages, archive_bytes=warc.ARCHIVE_BYTES):
    root = scratch_path(spark, "warc-test")
    warc.write_streams(pages, f"{root}/streams")
    warc.normalize(spark, f"{root}/streams", f"{root}/archives", archive_bytes)
    return root, warc.write_index(spark, f"{root}/archives", f"{root}/index")


def files(root):
    import pathlib

    return {p.parent.name.removeprefix("archive="): p for p in pathlib.Path(root.removeprefix("file:")).rglob("part-*") if "archives" in str(p)}


@pytest.mark.parametrize("archive_bytes", [600, warc.ARCHIVE_BYTES])
def test_round_trip_and_offsets(spark, archive_bytes):
    rng = random.Random(3)
    odd = ["\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "Content-Length: 5\r\n", "é漢😀", "a" * 50, "\x00"]
    html = [None, "", "x" * 999, "x" * 1000, "x" * 1000, "x" * 1000, "\r" * 1200, "y" * 70_000]
    html += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 5 else None, h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(3)
    root, index = run(spark, pages, archive_bytes)
    found = {r["page_id"]: r for r in index.collect()}
    assert len(found) == len(html)
    last = {}
    for i, h in enumerate(html):
        if len((h or "").encode()) >= 1000:
            last[h] = i
    stored = files(root)
    assert archive_bytes > 1000 or len(stored) > 3
    for i, h in enumerate(html):
        data, r = (h or "").encode(), found[i]
        assert r["payload_bytes"] == len(data)
        import hashlib

        assert r["payload_digest"] == hashlib.sha1(data).hexdigest()
        refers = last[h] if h in last and last[h] != i else None
        assert (r["record_type"], r["refers_to"]) == ("revisit" if refers is not None else "response", refers)
        raw = stored[r["archive"]].read_bytes()[r["offset"] : r["offset"] + r["length"]]
        record = zlib.decompress(raw, 31)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith((b"" if refers is not None else data) + b"\r\n\r\n")
    for path in stored.values():  # a plain gzip reader sees records only
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")
    some = index.where("page_id % 7 = 3")
    payloads = {(r["archive"], r["offset"]): bytes(r["payload"]) for r in warc.fetch(spark, f"{root}/archives", some).collect()}
    for r in some.collect():
        want = b"" if r["record_type"] == "revisit" else (html[r["page_id"]] or "").encode()
        assert payloads[r["archive"], r["offset"]] == want


def test_cutter_takes_any_parts_and_keeps_what_ends_early():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"z" * n) for n in (0, 3, 70)]
    stream = b"".join(records) + records[2][:40]
    for size in (1, 2, 7, 1000):
        cutter = warc.RecordCutter()
        got = [r for at in range(0, len(stream), size) for r in cutter.feed(stream[at : at + size])]
        assert got == records and cutter.rest() == records[2][:40]
    assert warc.parse(records[2][:40])[0] == "truncated"


def test_members_of_several_sizes():
    parts = [b"", b"a", b"b" * 100_000, random.Random(1).randbytes(50_000)]
    data = b"".join(warc.member(p) for p in parts)
    found = list(warc.members(memoryview(data)))
    assert [c for _, _, c in found] == parts
    assert sum(n for _, n, _ in found) == len(data)
    with pytest.raises(ValueError):
        list(warc.members(memoryview(data[:-3])))


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "u", "p" * 1500), (4, "u", "p" * 1500), (4, "u", "p" * 1500), (None, "v", "q" * 1500), (None, "v", "q" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, index = run(spark, pages)
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in index.collect()), key=repr)
    want = [(None, "revisit", 4), (4, "response", None), (4, "response", None), (None, "response", None), (None, "response", None)]
    assert found == sorted(want, key=repr)
    assert run(spark, pages.limit(0))[1].count() == 0
