"""The whole plan: the worked example, mates, records that are passed on, files, the command line, the stream."""

import gzip
import struct

import pytest

from strandloom import cli
from strandloom import schema as S
from strandloom.operators.align import SEMI, Cost, Region, cigar, cost_grid, rebase
from strandloom.plans import fixtures as T
from strandloom.plans import realign as R
from strandloom.sources import alignments as A
from strandloom.sources import costs as K
from strandloom.sources import sequences as Q
from strandloom.sources import tables as B

from .test_align import every_path

# a made-up place: 5 bases, a unit of 4 three times, 12 bases
LOCUS = "TTGAC" + 3 * "CATG" + "AAGTCCGATACT"
REF = f">chrA made up\n{LOCUS[:14]}\n{LOCUS[14:]}\n>chrB\nGGCATTGA\n"
PDC = K.generate_costs([("chrA", len(LOCUS))], [("chrA", 5, 17)], default=(2, -3, -4, -2), inside=(2, -3, -2, -1))
QUALM = "r chrA\nq 40 45\n~ 67 71 + 2\nQ\nR\n"


def sam(*rows):
    return "@HD\tVN:1.0\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows)


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return put


def records(spark, rows):
    """(qname, flag, rname, pos, cigar, seq) as records."""
    full = [(i, 0, q, f, r, p, 60, c, "", -1, 0, s, "5" * len(s), "NM:i:0\tXX:Z:y") for i, (q, f, r, p, c, s) in enumerate(rows)]
    return spark.createDataFrame(full, S.SAM)


def references(spark):
    return spark.createDataFrame([(0, "chrA made up", "chrA", LOCUS, None), (1, "chrB", "chrB", "GGCATTGA", None)], S.SEQUENCE)


def enumerated(read, qual, lo, hi, ranks):
    """(score, 1-based place, CIGAR) of all alignments with one of the ``ranks`` best scores, by trying all paths."""
    window = LOCUS[lo:hi]
    grid = K.mangle_grid(cost_grid(rebase(K.parse_costs(PDC)["chrA"], lo, hi), len(window), len(read)), K.parse_mangles(QUALM)["chrA"], lo, qual)
    paths = every_path(window, read, grid, SEMI)
    best = sorted({s for s, _ in paths}, reverse=True)[:ranks]
    return sorted((s, lo + p[0][0] + 1, cigar(*zip(*p, strict=True), len(read))) for s, p in paths if s in best)


@pytest.mark.parametrize("read,qual", [("CATGCA", "5555++"), ("CAGGCA", "++5555"), ("ATGA", "+5+5")])
def test_example(spark, files, tmp_path, read, qual):
    """A read near a problem region, from files to files, against all alignments with its window."""
    out = f"file://{tmp_path}/out"
    a = sam(("look", 0, "chrA", 9, 0, f"{len(read)}M", "*", 0, 0, read, qual))
    args = [files("a.sam", a), "--out", out, "--ref", files("r.fa", REF), "--prob", files("p.bed", "#x\nchrA\t8\t12\n"), "--cost", files("c.pdc", PDC), "--qualm", files("q.qualm", QUALM), "--overrun", "1", "--rank", "1", "--count", "10000", "--order"]
    cli.main(args)
    head, program, *rows = [r["value"] for r in spark.read.text(out).collect()]
    assert (head, program) == ("@HD\tVN:1.0", R.PROGRAM)
    rows = [r.split("\t") for r in rows]
    want = enumerated(read, qual, 7, 8 + len(read) + 1, 2)
    assert len(want) > 1 and sorted((int(r[11].split(":")[2]), int(r[3]), r[5]) for r in rows) == want
    assert {(r[0], r[2], r[9], r[10]) for r in rows} == {("look", "chrA", read, qual)}
    main = [r for r in rows if r[1] == "0"]
    assert len(main) == 1 and int(main[0][11].split(":")[2]) == want[-1][0] and all(r[1] == "256" for r in rows if r is not main[0])


def test_records_that_are_passed_on_and_mates(spark):
    read = LOCUS[9:15]
    rows = [
        ("p", 1 | 64, "chrA", 8, "6M", read), ("p", 1 | 128 | 16, "chrA", 20, "2S4M", "GTCCGA"),
        ("far", 0, "chrA", 0, "3M", "TTG"), ("unmapped", 4, "chrA", 0, "3M", "TTG"), ("what", 0, "chr9", 0, "3M", "TTG"),
        ("second", 256, "chrA", 8, "6M", read), ("bad", 0, "chrA", 8, "3M2S1M", read), ("costless", 0, "chrB", 0, "4M", "GGCA"),
        ("lone", 1 | 64, "chrA", 8, "6M", read), ("empty", 0, "chrA", 8, "6M", ""), ("q", 1 | 64, "chrA", 8, "6M", read), ("q", 1 | 128 | 4, "", -1, "", "AC"),
    ]
    problems = spark.createDataFrame([("chrA", 8, 12), ("chrB", 0, 3)], "chrom string, start long, end long")
    got = R.realign_records(records(spark, rows), references(spark), K.parse_costs(PDC), problems, None, R.Config(overrun=1, tags=["XX"])).collect()
    by = {(r["qname"], bool(r["flag"] & 128)): r for r in got}
    assert len(got) == 11 and ("second", False) not in by
    notes = {r["qname"]: r["note"] for r in got if r["qname"] not in ("p", "q")}
    assert notes == {"far": "no problem region", "unmapped": "not aligned", "what": "unknown reference", "bad": "malformed CIGAR", "costless": "no costs", "lone": "", "empty": "no sequence"}
    p, m = by["p", False], by["p", True]
    assert enumerated(read, "5" * 6, 7, 15, 1) == [(12, 10, "6M")]
    assert (p["note"], p["pos"], p["cigar"], p["extra"]) == ("", 9, "6M", "AS:i:12\tXX:Z:y")
    assert m["note"] == "no problem region" and m["extra"] == "XX:Z:y" and m["cigar"] == "2S4M"
    # the mate is passed on: its own range is inclusive, and what its mate sees of it exclusive
    assert (p["flag"], p["rnext"], p["pnext"], p["tlen"]) == (1 | 2 | 32 | 64, "chrA", 20, 24 - 9)
    assert (m["flag"], m["rnext"], m["pnext"], m["tlen"]) == (1 | 2 | 16 | 128, "chrA", 9, -(23 - 9))
    assert by["lone", False]["flag"] == 64 and by["unmapped", False]["flag"] == 4
    q, n = by["q", False], by["q", True]
    assert q["flag"] == 1 | 8 | 64 and q["rnext"] == "" and q["tlen"] == 0
    assert n["flag"] == 1 | 4 | 128 and n["rnext"] == "chrA" and n["tlen"] == 0
    assert by["bad", False]["flag"] & 4


def test_no_alignment_and_soft_clips(spark):
    cost = Cost(-9, -9, -9, (65, 67, 71, 84), tuple(tuple(-5 for _ in range(4)) for _ in range(4)))
    everything = {"chrA": [Region(None, None, None, None, cost)]}
    rows = records(spark, [("s", 0, "chrA", 9, "1S4M1S", "GCATGT")])
    kept = R.realign_records(rows, references(spark), K.parse_costs(PDC), None, None, R.Config(promiscuous=True)).first()
    assert kept["cigar"] == "1S4M1S" and kept["note"] == ""
    whole = R.realign_records(rows, references(spark), K.parse_costs(PDC), None, None, R.Config(promiscuous=True, reclaim=1)).first()
    assert whole["cigar"] != "1S4M1S"
    none = R.realign_records(rows, references(spark), everything, None, None, R.Config(promiscuous=True, mode="local")).collect()
    assert len(none) == 1


def test_configuration_errors(files):
    with pytest.raises(SystemExit):
        cli.main(["x.sam", "--out", "o", "--ref", "r", "--cost", "c"])
    with pytest.raises(ValueError):
        R.Config(rank=-1).check()
    with pytest.raises(ValueError):
        R.Config(mode="other").check()


def test_cost_and_mangle_files():
    costs = K.parse_costs(PDC + "text after the last bar is ignored")
    assert len(costs["chrA"]) == 2 and costs["chrA"][1].start_a == 5 and costs["chrA"][1].start_b is None
    with pytest.raises(ValueError):
        K.parse_costs("x -1 |")
    text = K.generate_costs([("r1", 50), ("r2", 9)], [("r1", 5, 9), ("r1", 40, 99), ("r2", 20, 30)])
    again = K.parse_costs(text)
    assert [(r.start_a, r.end_a) for r in again["r1"]] == [(None, None), (5, 9), (40, 50)] and len(again["r2"]) == 1
    sets = K.parse_mangles("r x\nq 33 40\nGo * 2\nGc = 7\nQ\nP 5 9\nq 35\n~ 65 67 / 2 - 1\nQ\nP\nR\n")["x"]
    assert sets[0].find(33) == 0 and sets[0].find(41) is None and (sets[1].low, sets[1].high) == (5, 9)
    cost = Cost(-3, -1, 0, (65, 67), ((1, -5), (-4, 1)))
    assert sets[0].mangles[0].apply(cost).open == -6 and sets[0].mangles[0].apply(cost).close == 7
    assert sets[1].mangles[0].apply(cost).mm == ((1, -3), (-4, 1))
    with pytest.raises(ValueError):
        K.parse_mangles("r x\nnonsense\nR")


def test_text_sources(spark, files, tmp_path):
    tsv = B.read_tsv(spark, files("t.tsv", "a\tb\\tc\r\n\nx\n"), escapes=True).orderBy("ord").collect()
    assert [r["cells"] for r in tsv] == [["a", "b\tc"], [""], ["x"]]
    bed = B.read_bed(spark, files("b.bed", "#c\nchr1\t5\t9\textra\nchr1\t5\nchr2\tx\t3\n")).collect()
    assert sorted(tuple(r) for r in bed) == [("chr1", 5, 9), ("chr2", 0, 3)]
    fa = Q.read_sequences(spark, files("s.fa", REF)).orderBy("ord").collect()
    assert [(r["name"], r["short_name"], len(r["seq"])) for r in fa] == [("chrA made up", "chrA", 29), ("chrB", "chrB", 8)]
    fq = Q.read_sequences(spark, files("s.fq", "@r1 x\nACG\n+\n!5~\n@r2\nA\n+\n5\n")).orderBy("ord").collect()
    assert [(r["short_name"], r["seq"]) for r in fq] == [("r1", "ACG"), ("r2", "A")] and fq[0]["qual"] == [0.0, -2.0, -9.3]
    assert B.read_settings(spark, files("x.ini", "; c\n[s]\na = 1\n#d\nb=x=y\n")) == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        B.read_settings(spark, files("y.ini", "novalue\n"))
    seqs = Q.read_fasta(spark, files("s2.fa", REF))
    Q.write_fasta(seqs, f"file://{tmp_path}/fa")
    assert Q.read_fasta(spark, f"file://{tmp_path}/fa").count() == 2
    Q.write_indexed(seqs, f"file://{tmp_path}/i.parquet")
    first = seqs.orderBy("ord").first()["ord"]
    assert Q.read_indexed(spark, f"file://{tmp_path}/i.parquet", first, 3, 4).first()["seq"] == LOCUS[3:7]


def test_gzip_and_points(spark, files, tmp_path):
    from strandloom.sources.points import read_points

    a = sam(("r", 0, "c", 5, 60, "3M", "*", 0, 0, "ACG", "555"), ("s", 0, "c", 6, 60, "3M", "*", 0, 0, "ACG", "555"))
    for name in ("a.sam.gz", "a.sam.gzip"):
        (tmp_path / name).write_bytes(gzip.compress(a.encode()))
        records, headers = A.read_alignments(spark, f"file://{tmp_path}/{name}")
        assert [r["qname"] for r in records.orderBy("ord").collect()] == ["r", "s"] and headers.count() == 1
    path = files("p.tsv", "x\tkind\tn\n1.5\tb\t3\nz\ta\t4x\n2\tb\t5\n")
    rows, levels = read_points(spark, path, {"kind": "cat", "n": "int", "x": "flt"})
    assert [(r["kind"], r["n"], r["x"]) for r in rows.orderBy("ord").collect()] == [(0, 3, 1.5), (1, 4, None), (0, 5, 2.0)]
    assert {r["level"]: r["code"] for r in levels["kind"].collect()} == {"b": 0, "a": 1}
    with pytest.raises(ValueError):
        read_points(spark, path, {"y": "int"})
    sets = K.parse_mangles("r x\nq 33\nQ\nP 5 9\nq 35\nQ\nP 20 30\nq 35\nQ\nR\n")["x"]
    assert [(s.low, s.high) for s in K.rebase_mangles(sets, 6, 22)] == [(None, None), (0, 3), (14, 16)]


def test_graph_text(spark, files):
    seq, edges = Q.parse_graph("g", "AC&x;G[x /]T")
    assert seq == "ACGT" and edges == [(0, 1), (1, 2), (2, 3)]
    for bad in ("A[]C", "A[y]C", "A]C", "A[x"):
        with pytest.raises(ValueError):
            Q.parse_graph("g", bad)
    got = Q.read_graphs(spark, files("g.fa", ">g1 x\nA&n;C\n[n]G\n")).first()
    assert got["graph"] == "g1" and got["seq"] == "ACG" and [(e["src"], e["dst"]) for e in got["edges"]] == [(0, 1), (1, 2)]


def test_sam_round_trip_and_errors(spark, files, tmp_path):
    a = sam(("r", 0, "c", 5, 60, "3M", "=", 9, 4, "ACG", "555", "NM:i:1", "XA:Z:b"), ("*", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*"))
    both = A.read_alignments(spark, [files("a.sam", a), files("b.sam", "x\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")])
    A.write_sam(both[0], both[1], f"file://{tmp_path}/o", single_file=True)
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/o").collect()]
    assert "\n".join(lines) + "\n" == a + "x\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    first = both[0].orderBy("ord").first()
    assert (first["pos"], first["pnext"], first["extra"]) == (4, 8, "NM:i:1\tXA:Z:b")
    for bad in ("r\t0\tc\n", "r\t0\tc\t5\t60\t3M\t=\t9\t4\tACG\t5\n"):
        with pytest.raises(Exception):  # noqa: B017
            A.read_sam(spark, files(f"bad{len(bad)}.sam", bad))[0].collect()


def test_bam(spark, tmp_path):
    name, seq = b"read1\0", "ACGTN"
    packed = bytes("=ACMGRSVTWYHKDBN".index(x) << 4 | "=ACMGRSVTWYHKDBN".index(y) for x, y in zip(seq[::2], seq[1::2] + "=", strict=True))
    tags = b"NMC\x07" + b"XZZhi\0" + b"XBBs" + struct.pack("<ihh", 2, -1, 5) + b"XAAq" + b"XFf" + struct.pack("<f", 1.5)
    body = struct.pack("<iiBBHHHiiii", 0, 4, len(name), 30, 0, 2, 16, 5, -1, -1, 0) + name + struct.pack("<II", 2 << 4 | 4, 3 << 4) + packed + bytes([1, 2, 3, 4, 5]) + tags
    text = b"@HD\tVN:1\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chrZ\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))
    rows, heads = A.read_alignments(spark, f"file://{tmp_path}/x.bam")
    r = rows.first()
    assert [h["text"] for h in heads.collect()] == ["@HD\tVN:1"]
    assert (r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["qual"], r["pnext"]) == ("read1", 16, "chrZ", 4, 30, "2S3M", seq, "\"#$%&", -1)
    assert r["extra"] == "NM:i:7\tXZ:Z:hi\tXB:B:s,-1,5\tXA:A:q\tXF:f:1.5"


def test_pair_stream(spark, tmp_path):
    from strandloom.streaming.pairing import pair_stream

    src = f"file://{tmp_path}/in"
    schema = "qname string, ord long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 5)], schema).coalesce(1).write.parquet(src)

    def run():
        out = pair_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").outputMode("append")
        out.option("checkpointLocation", f"file://{tmp_path}/ck").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(120)

    run()
    spark.createDataFrame([("b", 9), ("a", 7)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.schema("qname string, first long, second long").parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r["qname"], r["first"], r["second"]) for r in got) == [("a", 1, 3), ("a", 5, 7), ("b", 2, 9)]


def test_bases_of_documents_are_made_once(spark, tmp_path):
    texts = {0: "Ab c-d", 1: None, 2: "", 3: "lorem ipsum é dolor " * 30, 900: "x" * 66 + "Yz"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    recs, seqs = T.records(spark, str(tmp_path))
    for df in (recs, seqs):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    bases = {k: "".join("ACGT"[(ord(c) - 65) % 4] for c in (t or "").upper() if "A" <= c <= "Z") for k, t in texts.items()}
    assert {r.ord: r.seq for r in seqs.collect()} == bases
    want = {}
    for k, b in bases.items():
        for mate in (0, 1):
            pos = (k * 7 + mate * 61) % max(len(b) - 65, 1)
            piece = b[pos : pos + 65]
            want[2 * k + mate] = (pos, piece[:25] + piece[27:62] if mate else piece[:30] + piece[30:31].translate(str.maketrans("ACGT", "TGCA")) + piece[31:60])
    assert {r.ord: (r.pos, r.seq) for r in recs.collect()} == want
