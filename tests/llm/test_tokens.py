import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import textnum as tn
from strandloom.llm import token_store as s
from strandloom.llm.queries import tokenizer_path
from strandloom.llm.tokens import Encoder, encoder

from .conftest import even_and_odd


def library(texts):
    tok = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library():
    r = random.Random(1)
    enc = Encoder(tokenizer_path())
    assert enc.by_piece
    for alphabet in ("ab sS'tredvmlL  \n\t 09,.!?\"'éÉñü×÷«¿\x1c\x85\u200b中٣²ſ\x0b\x0c", "ab sS'tredvml  \n\t\r 09,.!?\"'éÉñü"):
        parts = [*alphabet, "'s", "'re", " ", "\r\n", "<|endoftext|>"]
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", " ", "x" * 70_000, "end <|endoftext|> more", *even_and_odd()]
        got = []
        for _, ids, n in enc.encode(pa.array([*texts, None])):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [*library(texts), []]


def test_held_pieces_are_told_by_their_bytes():
    enc = Encoder(tokenizer_path())
    for texts in (even_and_odd(), even_and_odd()[::-1], ["a" * n + "b" for n in range(1, 40)], ["a" * n for n in range(1, 40)]):
        got = []
        for _, ids, n in enc.encode(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == library(texts)
    assert encoder(tokenizer_path()) is encoder(tokenizer_path())


def test_words_have_hashes_of_their_own():
    words = [*even_and_odd(), *("a" * n for n in range(1, 200)), *("b" * n for n in range(1, 200)), "ab", "ba", "a\0", "A"]
    data, offsets = tn.text_bytes(pa.array(words))
    h, row, start, end = tn.words(data, offsets)
    assert len(h) == len(words) and len(set(h.tolist())) == len(words) - 1  # A is a
    again = tn.words(*tn.text_bytes(pa.array([" ".join(words)])))[0]
    assert (again == h).all()


def test_round_trip(spark, frame, tmp_path):
    rows = [(3, "three words here", "x"), (1, None, "x"), (2, "", "x"), (10, "long text " * 5000, "x"), (None, "no id", "x"), (3, "three words here", "x"), (3, "another", "x")]
    docs = frame(rows, "doc_id long, text string, start string")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in s.token_round_trip(docs, tokenizer_path()).collect()), key=lambda x: x[0])
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [x[1] for x in got] == [None, 1, 2, 3, 3, 3, 10]
    want = sorted((k or 0, zlib.crc32(np.array([*library([t or ""])[0], 0], "<u4").tobytes())) for k, t, _ in rows)
    assert sorted((x[1] or 0, x[3]) for x in got) == want
    assert s.token_round_trip(frame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    s.write_tokens(docs, f"file://{tmp_path}/t", tokenizer_path())
    one = s.read_tokens(spark, f"file://{tmp_path}/t", F.col("doc_id") == 10).select("n_tokens")
    assert one.collect()[0][0] == got[-1][2]
    plan = one._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1] and "PushedFilters" in plan


def test_the_files_are_encoded_as_promised(frame, tmp_path):
    """Dictionary or delta encoding, small row groups, and page indexes, from the footers."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(10**6):x}" for _ in range(300))) for i in range(2000)]
    s.write_tokens(frame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", tokenizer_path())
    pages = 0
    for file in sorted((tmp_path / "t" / "parts").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 2 * s.ROW_GROUP_BYTES
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and col.has_column_index, col.path_in_schema
                assert set(col.encodings) & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY"}, col.encodings
                if col.path_in_schema.startswith("ids") and col.num_values:
                    pages += 1
    assert pages
