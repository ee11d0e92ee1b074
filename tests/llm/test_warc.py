"""Operator 4: an exact round trip."""

import base64
import hashlib
import os
import tempfile
import zlib

from flowlens.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, digest string, id long")


def rows():
    out = [(i, f"http://x/{i}", f"<p>page {i % 40} é</p>" * (i % 7 + 1)) for i in range(300)]
    return out + [(300, None, None), (301, "u", ""), (302, "http://x/\r\ninjected: y", "a\r\n\r\nb"), (None, "u", "null id"),
                  (303, "u", "null id"), (304, "u", "same"), (304, "u", "same"), (305, "u", "z" * 400_000)]


def want(data, min_bytes=0):
    by = {}
    for n, (i, _, h) in enumerate(sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))):
        p = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        known = by.setdefault(d, []) if len(p) >= min_bytes else []
        yield (i, len(p), d, "revisit" if known else "response", known[0] if known else None)
        known.append(i)


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def test_round_trip(spark):
    data = rows()
    for options in ({}, {"file_bytes": 2000, "shard_bytes": 5000}, {"min_bytes": 40}):
        got = [tuple(r) for r in warc.round_trip(pages(spark, data), **options).collect()]
        assert sorted(got, key=key) == sorted(want(data, options.get("min_bytes", 0)), key=key)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_archives_are_deterministic_and_named_by_the_manifest(spark):
    data, digests = rows(), []
    for order in (data, data[::-1]):
        root = f"file://{tempfile.mkdtemp()}/w"
        warc.write_warc(pages(spark, order).repartition(3), root, file_bytes=3000, shard_bytes=20_000)
        folder = root.removeprefix("file://")
        manifest = spark.read.parquet(f"{root}/manifest").collect()
        names = sorted(os.listdir(f"{folder}/data"))
        assert sorted(r.file for r in manifest) == [n for n in names if not n.endswith(".crc")]
        for r in manifest:
            data_ = open(f"{folder}/data/{r.file}", "rb").read()
            assert (len(data_), hashlib.sha256(data_).hexdigest()) == (r.bytes, r.sha256)
            assert data_[:3] == b"\x1f\x8b\x08" and data_[4:8] == b"\0\0\0\0"
        ranges = sorted((r.first_id or -1, r.last_id or -1) for r in manifest)
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
        digests.append(sorted(h["WARC-Payload-Digest"] for r in manifest for h, _ in
                              warc.parse(open(f"{folder}/data/{r.file}", "rb").read()) if h["WARC-Type"] == "response"))
        assert not os.listdir(f"{folder}/_temporary")
        # a file that no manifest names is not read
        open(f"{folder}/data/stray.warc.gz", "wb").write(b"junk")
        assert warc.read_warc(spark, root).count() == len(data)
    assert digests[0] == digests[1]


def test_damage_is_noticed():
    good = warc.page_record(1, "u", b"payload", None, False, 0)
    assert warc.page_of(*next(warc.parse(good)))["payload_bytes"] == 7
    raw = zlib.decompress(good, 31).replace(b"payload", b"pay1oad")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    try:
        list(warc.parse(z.compress(raw) + z.flush()))
        raise AssertionError("damage passed")
    except ValueError as e:
        assert "digest" in str(e)


def archive(spark, df, **options):
    root = f"file://{tempfile.mkdtemp()}/w"
    warc.write_warc(df, root, **options)
    folder = root.removeprefix("file://")
    return {n: open(f"{folder}/data/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/data")) if not n.endswith(".crc")}


def test_two_writes_of_many_rows_give_equal_files(spark):
    """Enough rows for range partitions to be sampled; other partitions, other
    order, equal bytes."""
    data = [(i * (10**9 if i % 97 == 0 else 1), f"http://x/{i}", f"<p>{i * 7919 % 9000}</p>" * (i % 9 + 1)) for i in range(10_000)]
    data += [(5, f"u{k}", "same id and text") for k in range(3)]
    options = {"file_bytes": 20_000, "shard_bytes": 60_000}
    first = archive(spark, pages(spark, data), **options)
    second = archive(spark, pages(spark, data[::-1]).repartition(13), **options)
    assert len(first) > 8 and first == second
    assert len({n.split("-")[1] for n in first}) > 5


def test_a_repeated_task_changes_nothing(spark):
    root = f"file://{tempfile.mkdtemp()}/w"
    for attempt in (1, 2, 3):
        w = warc.ShardWriter(root, 0, attempt, 10**6)
        if attempt == 3:  # what a lost task has left half written under the final name
            open(f"{w.root}/data/shard-000000-00000.warc.gz", "wb").write(b"half")
        w.write(1, warc.page_record(1, "u", b"payload", None, False, 0))
        w.close()
        names = [n for n in os.listdir(f"{w.root}/data")]
        assert names == ["shard-000000-00000.warc.gz"] and not os.listdir(f"{w.root}/_temporary")
        data = open(f"{w.root}/data/{names[0]}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == w.rows[0]["sha256"]


def test_plain_paths_get_their_file_system(spark):
    assert warc.qualified(spark, "/a/b") == "file:///a/b" and warc.qualified(spark, "file:/a/b") == "file:///a/b"


def test_shards_by_key(spark):
    starts = [(0, 0, "a"), *[(1, i * 10, "m") for i in range(50)]]
    df = spark.createDataFrame([(i, "n") for i in range(0, 505, 5)] + [(None, "b"), (0, "a")], "id long, digest string")
    for r in df.withColumn("s", warc.shard_of(starts)).collect():
        key = (int(r["id"] is not None), r["id"] or 0, r["digest"])
        assert r["s"] == sum(s <= key for s in starts) - 1, key


def test_many_records_are_read_in_linear_time():
    import time
    data = warc.page_record(1, "u", b"x" * 50, None, False, 0) * 20_000
    t = time.time()
    assert sum(1 for _ in warc.parse(data)) == 20_000 and time.time() - t < 20
