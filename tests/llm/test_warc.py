import hashlib
import io
import random

import duckdb
import pytest
import zstandard

from rolloom.llm import queries, skew, warc
from rolloom.session import work_path

LONG = "<html>" + "long page " * 40
ROWS = [
    (5, "http://a/1", LONG),
    (3, "http://a/2", LONG),
    (3, "http://a/2", LONG),
    (9, None, LONG),
    (None, "http://b/ x\r\nEvil: 1", LONG),
    (6, "http://c/é中", "short"),
    (7, "", "short"),
    (8, "http://d", None),
    (10, "http://d", ""),
    (11, "http://e", "é" * 50),
    (12, "http://e", "é" * 50),
    (13, "http://f", "x" * 99),
    (14, "http://f", "x" * 99),
    (15, "http://g", "a\r\n\r\nb\x00" * 60),
    (16, "http://h", "y" * 3_000_000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_query_equals_its_sql(spark, tmp_path):
    pages(spark).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(queries.ORACLES["op11_warc_archives"])
    got = queries.op11_warc_archives(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(rel.columns)
    show = lambda rows: sorted(map(str, rows))
    assert show(tuple(r) for r in got.select(*rel.columns).collect()) == show(rel.fetchall())


def test_payloads_urls_and_references_come_back(spark):
    found = warc.read(warc.write(pages(spark), work_path(spark, "t"))).collect()
    assert all(r["intact"] for r in found) and len(found) == len(ROWS)
    by_id = {r["record_id"]: r for r in found}
    assert len(by_id) == len(ROWS)
    texts = {k: (h or "").encode() for k, _, h in ROWS}
    for r in found:
        want = texts[int(r["page"]) if r["page"] else None]
        assert r["payload"] == (None if r["record_type"] == "revisit" else want)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
        if r["record_type"] == "revisit":
            first = by_id[r["refers_to_record"]]
            assert first["record_type"] == "response" and first["payload"] == want and first["page"] == r["refers_to"]
    urls = {r["page"]: r["url"] for r in found}
    assert urls[None] == "http://b/%20x%0D%0AEvil:%201" and urls["9"] is None and urls["7"] is None and urls["6"] == "http://c/é中"


def test_archives_are_plain_frames_behind_a_dictionary(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))) for i in range(400)]
    folder = work_path(spark, "t")
    ranges = warc.write(pages(spark, rows).coalesce(1), folder, range_bytes=4096, archive_bytes=1 << 15, sample_bytes=1 << 16).collect()
    by_path = {}
    for r in ranges:
        by_path.setdefault(r["path"], []).append(r)
    assert len(by_path) > 1 and sum(r["records"] for r in ranges) == 400
    for path, own in by_path.items():
        raw = open("/" + path.removeprefix("file:").lstrip("/"), "rb").read()
        size = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == warc.SKIPPABLE and size > 0
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        assert dictionary.dict_id()
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [8 + size, *(r["stop"] for r in own)][:-1] and own[-1]["stop"] == len(raw)
        # a range is read alone, and by a plain decompressor that gets the dictionary
        text = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(raw[own[-1]["start"] :]), read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\n") == own[-1]["records"] and text.endswith(b"\r\n\r\n")
    got = warc.read(warc.manifest(spark, folder))
    assert {(int(r["page"]), r["payload"].decode()) for r in got.collect()} == {(k, h) for k, _, h in rows}
    files = warc.archive_files(spark, f"{folder}/*.warc.zst")
    assert warc.read(files, payload=False).where("intact").count() == 400


def test_files_outside_the_manifest_are_not_read(spark):
    folder = work_path(spark, "t")
    ranges = warc.write(pages(spark), folder)
    store, inner = warc.open_store(warc.qualified(spark, folder))
    with store.open_output_stream(f"{inner}/lost-attempt.warc.zst", compression=None) as out:
        out.write(b"half a record")
    assert warc.read(ranges).count() == len(ROWS)


def test_compressed_dictionaries_and_damage():
    raw = warc.record(warc.uuid.uuid4(), "2020-01-01T00:00:00Z", 1, "1", "u", b"x" * 200, 200, hashlib.sha256(b"x" * 200).hexdigest(), None, None)
    dictionary = warc.trained([raw.replace(b"x", bytes([65 + i])) for i in range(60)])
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    frame = zstandard.ZstdCompressor(dict_data=dictionary).compress(raw)
    whole = warc.SKIPPABLE + len(packed).to_bytes(4, "little") + packed + frame
    stream = io.BytesIO(whole)
    found, at = warc.dictionary_of(stream)
    assert list(warc.frames(stream, len(whole), found)) == [raw] and at == 8 + len(packed)
    assert warc.parsed(raw)[9] and not warc.parsed(raw.replace(b"xxx", b"xyx", 1))[9] and not warc.parsed(raw[:-5])[9] and not warc.parsed(b"")[9]
    stream.seek(at)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(stream, len(whole) - 3, found))


def test_few_records_have_no_dictionary():
    assert warc.trained([]) is None and warc.trained([b"x"]) is None


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("hot_keys", [1, 4, 1 << 17])
def test_hot_and_cold_keys_join_alike(spark, hot_keys):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 10 + [3, 4, 5, None])], "k long, i long")
    table = rows.where("k is not null").groupBy("k").agg(skew.F.count("*").alias("n")).where("k <> 5")
    got = skew.join_counted(rows, table, "k", "n", hot_keys)
    assert sorted((r["k"], r["i"], r["n"]) for r in got.collect()) == sorted((k, i, {1: 50, 2: 10}.get(k, 1)) for i, k in enumerate([1] * 50 + [2] * 10 + [3, 4]))
