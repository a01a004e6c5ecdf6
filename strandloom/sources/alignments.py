"""Alignment records: SAM text, BAM files, and SAM written."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from .lines import FILE_BITS, nth, read_gzip_lines, read_lines
from .tables import cells


def _text(c: Column) -> Column:
    """``*`` stands for an empty field."""
    return F.when(c == "*", "").otherwise(c)


def parse_sam(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, headers) of (ord, file_idx, value). Header lines start with ``@``, blank lines are skipped;
    fewer than 11 cells, or a quality of another length than its sequence, are an error."""
    rows = lines.filter(F.trim(F.replace("value", F.lit("\r"), F.lit(""))) != "")
    head = F.startswith("value", F.lit("@"))
    headers = rows.filter(head).select("ord", "file_idx", F.replace("value", F.lit("\r"), F.lit("")).alias("text"))
    c = F.col("c")
    body = rows.filter(~head).select("ord", "file_idx", cells(F.col("value")).alias("c"))
    seq, qual = _text(nth(c, 9)), _text(nth(c, 10))
    checked = F.when(F.size(c) < 11, F.raise_error(F.lit("an alignment line has fewer than 11 cells"))).when((qual != "") & (F.length(qual) != F.length(seq)), F.raise_error(F.lit("a quality and its sequence differ in length"))).otherwise(qual)
    extra = F.array_join(F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(0))), "\t")
    records = body.select(
        "ord", "file_idx", _text(nth(c, 0)).alias("qname"), X.atol(nth(c, 1)).cast("int").alias("flag"), _text(nth(c, 2)).alias("rname"), (X.atol(nth(c, 3)) - 1).alias("pos"),
        X.atol(nth(c, 4)).cast("int").alias("mapq"), _text(nth(c, 5)).alias("cigar"), _text(nth(c, 6)).alias("rnext"), (X.atol(nth(c, 7)) - 1).alias("pnext"), X.atol(nth(c, 8)).alias("tlen"),
        seq.alias("seq"), checked.alias("qual"), extra.alias("extra"),
    )
    return records, headers


def read_sam(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Text, also gzip (``.gz`` by Spark's codec, ``.gzip`` unpacked here)."""
    one = paths if isinstance(paths, str) else paths[0]
    return parse_sam((read_gzip_lines if one.endswith(".gzip") else read_lines)(spark, paths))


# The codes of the binary format
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _number(kind: str, data: bytes, at: int):
    form = _NUMBERS[kind]
    return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)


def _show(kind: str, x) -> str:
    return f"{x:g}" if kind == "f" else str(x)


def _tags(data: bytes, at: int) -> Iterator[tuple[str, str, object]]:
    """(tag, type, value) of the optional fields; arrays are lists after their type."""
    while at < len(data):
        tag, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in _NUMBERS:
            value, at = _number(kind, data, at)
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at, items = at + 5, []
            for _ in range(n):
                x, at = _number(sub, data, at)
                items.append(x)
            value = (sub, items)
        else:
            raise ValueError(f"unknown type {kind!r} of an optional field")
        yield tag, kind, value


def decode_bam(data: bytes) -> tuple[list[str], list[tuple]]:
    """Header lines, and the records as (qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, extra)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)  # all members
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    size = struct.unpack_from("<i", data, 4)[0]
    header = [x for x in data[8 : 8 + size].split(b"\0")[0].decode("latin-1").split("\n") if x.strip()]
    if any(not x.startswith("@") for x in header):
        raise ValueError("a header line does not start with @")
    at = 8 + size
    count, at = struct.unpack_from("<i", data, at)[0], at + 4
    names = []
    for _ in range(count):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode("latin-1"))
        at += 8 + n
    name = lambda i: "" if i < 0 else names[i]
    out = []
    while at < len(data):
        length = struct.unpack_from("<i", data, at)[0]
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p, end = at + 36, at + 4 + length
        qname = data[p : p + n_name - 1].decode("latin-1")
        p += n_name
        ops = struct.unpack_from(f"<{n_ops}I", data, p)
        p += 4 * n_ops
        packed = data[p : p + (n_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
        p += (n_seq + 1) // 2
        qual = "" if not n_seq or data[p] == 255 else "".join(chr(min(q, 93) + 33) for q in data[p : p + n_seq])
        p += n_seq
        tags = list(_tags(data[:end], p))
        long_ops = next((v[1] for t, k, v in tags if t == "CG" and k == "B" and v[0] == "I"), None)
        if long_ops is not None and ops and ops[0] & 15 == 4 and ops[0] >> 4 == n_seq:
            ops, tags = long_ops, [x for x in tags if x[0] != "CG"]
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops)
        shown = []
        for t, k, v in tags:
            if k == "B":
                shown.append(f"{t}:B:{','.join([v[0], *(_show(v[0], x) for x in v[1])])}")
            else:
                shown.append(f"{t}:{'i' if k in 'cCsSiI' else k}:{_show(k, v)}")
        out.append(("" if qname == "*" else qname, flag, name(ref), pos, mapq, cigar, name(next_ref), next_pos, tlen, seq, qual, "\t".join(shown)))
        at = end
    return header, out


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content, file_idx in zip(batch["content"], batch["file_idx"], strict=True):
            header, rows = decode_bam(bytes(content))
            base = int(file_idx) << FILE_BITS
            yield pd.DataFrame([(base + i, file_idx, True, x, "", 0, "", -1, 0, "", "", -1, 0, "", "", "") for i, x in enumerate(header)], columns=_COLUMNS)
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                yield pd.DataFrame([(base + len(header) + i + k, file_idx, False, "", *r) for k, r in enumerate(part)], columns=_COLUMNS)


_COLUMNS = ["ord", "file_idx", "is_header", "text", *[f.name for f in S.SAM.fields][2:]]


def read_bam(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(records, headers); a file is read by one task, as its blocks are members of one gzip stream."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frame = spark.read.format("binaryFile").load(paths)
    listed = F.split(F.lit("\n".join(sorted(frame.inputFiles(), key=lambda f: (min((i for i, p in enumerate(paths) if f.endswith(p)), default=len(paths)), f)))), "\n")
    frame = frame.select((F.array_position(listed, F.col("_metadata.file_path")) - 1).cast("int").alias("file_idx"), "content")
    kinds = {f.name: f.dataType.simpleString() for f in S.SAM.fields} | {"is_header": "boolean", "text": "string"}
    rows = frame.repartition(max(1, len(paths))).mapInPandas(_decode, ", ".join(f"{c} {kinds[c]}" for c in _COLUMNS))
    return rows.filter("not is_header").select(*S.SAM.fieldNames()), rows.filter("is_header").select("ord", "file_idx", "text")


def read_alignments(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Records and headers of all files in the order given; ``.bam`` files are binary, all others are text (gzip by suffix)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    both = []
    for i, p in enumerate(paths):
        records, headers = read_bam(spark, p) if p.endswith(".bam") else read_sam(spark, p)
        shift = lambda df: df.withColumns({"ord": F.col("ord") + (i << FILE_BITS), "file_idx": F.col("file_idx") + i})  # noqa: B023, E731
        both.append((shift(records), shift(headers)))
    records, headers = both[0]
    for r, h in both[1:]:
        records, headers = records.unionByName(r), headers.unionByName(h)
    return records, headers


def sam_line(extra_last: bool = True) -> Column:
    """The text of a record; empty fields are ``*``, and there is no cell for an empty extra."""
    star = lambda c: F.when(F.col(c) == "", "*").otherwise(F.col(c))
    number = lambda c: F.col(c).cast("string")
    place = lambda c: (F.col(c) + 1).cast("string")
    fixed = [star("qname"), number("flag"), star("rname"), place("pos"), number("mapq"), star("cigar"), star("rnext"), place("pnext"), number("tlen"), star("seq"), star("qual")]
    line = F.concat_ws("\t", *fixed)
    return F.when(F.col("extra") == "", line).otherwise(F.concat_ws("\t", line, "extra")) if extra_last else line


def write_sam(records: DataFrame, headers: DataFrame | None, path: str, single_file: bool = False) -> None:
    """Headers first, then records by (ord, aln_idx); one file on request (that goes through one task)."""
    index = F.col("aln_idx") if "aln_idx" in records.columns else F.lit(0)
    rows = records.select(F.lit(1).alias("k"), "ord", index.cast("int").alias("aln_idx"), sam_line().alias("value"))
    if headers is not None:
        rows = headers.select(F.lit(0).alias("k"), "ord", F.lit(0).alias("aln_idx"), F.col("text").alias("value")).unionByName(rows)
    rows = rows.orderBy("k", "ord", "aln_idx").select("value")
    (rows.coalesce(1) if single_file else rows).write.text(path)
