import zlib

import pytest

from strandloom.llm import queries as q
from strandloom.llm import sharding as s


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation_and_inverse(n):
    places = [s.place_of(i, n) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [s.row_at(p, n) for p in places] == list(range(n))


def test_frame_follows_the_formula(frame):
    rows = [(None, "z", 1), *[(i * 3 % 101, "a", 1) for i in range(101)], (5, "b", 1)]
    got = s.feistel_shards(frame(rows, "doc_id long, text string, shard int"), ["doc_id", "text"], 16).collect()
    ordered = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"]))
    for i, r in enumerate(ordered):
        place = s.place_of(i, 103)
        assert (r["shard"], r["slot"]) == (place % 16, place // 16)


def test_repeated_rows_and_no_rows(frame):
    got = s.feistel_shards(frame([(1, "x")] * 50 + [(2, None)], "doc_id long, text string"), ["doc_id"], 4).collect()
    sizes = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(4)]
    assert all(x == list(range(len(x))) for x in sizes) and sorted(map(len, sizes)) == [12, 13, 13, 13]
    assert s.feistel_shards(frame([], "doc_id long"), ["doc_id"]).count() == 0


def test_written_shards(spark, frame, tmp_path):
    s.write_shards(s.feistel_shards(frame([(i,) for i in range(64)], "doc_id long"), ["doc_id"], 4), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").groupBy("shard").count().count() == 4


def test_query_keeps_its_law(frame, tmp_path):
    rows = [(i, "é中 " * (i % 7) + f"t{i % 40}", "x", 1) for i in range(400)] + [(900, None, None, 2), (901, "", "y", None), (None, "no id", "z", 3), (5, "of another text", "x", 1), (6, "é中 " * 6 + "t6", "x", 1), (902, "long " * 50_000, "x", 1)]
    frame(rows, "doc_id long, text string, source string, shard int").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark = frame([], "x int").sparkSession
    got = q.op7_sharding(spark, f"file://{tmp_path}").collect()
    data = [(k, (t or "").encode()) for k, t, _, _ in rows]
    want = sorted(((k, len(b) + 1, zlib.crc32(b)) for k, b in data), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    places = [s.place_of(i, len(rows)) for i in range(len(rows))]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=str) == sorted(((*w, p % 16, p // 16) for w, p in zip(want, places, strict=True)), key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    sizes = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(16)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_query_of_an_empty_table(frame, tmp_path):
    df = frame([], "doc_id long, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert q.op7_sharding(df.sparkSession, f"file://{tmp_path}").collect() == []
