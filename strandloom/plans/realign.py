"""Realignment of records near problem regions, as one plan.

read -> primary records -> CIGAR columns -> reference length, region overlap -> window -> kernel on those
that need it -> mates -> SAM rows. Shuffles: one by record for the region overlap (unless the regions
are few, and broadcast at run time), one by read name for mates. Everything else stays in its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import cigar as C
from ..functions import sam
from ..operators import intervals, pairs, reference
from ..operators.align import GLOBAL, LOCAL, SEMI, Options, cigar, cost_grid, realign_many, rebase
from ..operators.order import cut
from ..sources import alignments as A
from ..sources import costs as K
from ..sources import sequences as Q
from ..sources import tables as B

PROGRAM = "@PG\tID:strandloom\tVN:1"


@dataclass(frozen=True)
class Config:
    """The settings of a run; ``problems`` may be left out only if ``promiscuous``."""

    overrun: int = 20
    max_expand: int = -1
    mode: str = SEMI
    rank: int = 0
    count: int = 1
    reclaim: int = 0
    repeats: int = 0
    promiscuous: bool = False
    ordered: bool = False
    tags: list[str] = field(default_factory=list)

    def check(self) -> Config:
        if self.mode not in (SEMI, GLOBAL, LOCAL):
            raise ValueError(f"unknown mode {self.mode!r}")
        for name in ("overrun", "rank", "count", "reclaim", "repeats"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        return self


_ALN = "array<struct<score:long,pos:long,end:long,cigar:string,main:boolean>>"


def _kernel(costs: dict, mangles: dict | None, options: Options):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids: dict = {}
        for batch in batches:
            rows = list(zip(batch["rname"], batch["window"], batch["read"], batch["read_qual"], batch["win_lo"], batch["win_hi"], strict=True))
            out: list = [None] * len(rows)
            for first in range(0, len(rows), 512):
                problems = []
                for rname, window, read, qual, lo, hi in rows[first : first + 512]:
                    grid = cost_grid(rebase(costs[rname], lo, hi), len(window), len(read), grids)
                    problems.append((window, read, grid if mangles is None else K.mangle_grid(grid, mangles[rname], lo, qual)))
                for q, found in realign_many(problems, options):
                    lo = rows[first + q][4]
                    out[first + q] = [{"score": x.score, "pos": lo + x.a[0], "end": lo + x.a[-1], "cigar": cigar(x.a, x.b, len(problems[q][1])), "main": main} for x, _, main in found]
            yield pd.DataFrame({"ord": batch["ord"], "alns": out})

    return run


def realign_records(records: DataFrame, sequences: DataFrame, costs: dict, problems: DataFrame | None = None, mangles: dict | None = None, config: Config = Config()) -> DataFrame:
    """SAM rows with ``aln_idx``, ``score`` (null for records that are passed on) and ``note`` (why one is).

    Secondary and supplementary records are dropped. A record that is unaligned, malformed, on an unknown
    reference, away from the problem regions, or without costs, mangles or sequence is passed on with its
    kept flags and tags. Alternatives after the primary are secondary. Costs and mangles are settings, and go to each task.
    """
    config.check()
    n0 = F.lit(0).cast("long")
    rows = records.filter(sam.is_primary(F.col("flag")))
    aligned = sam.is_aligned(F.col("flag"), F.col("pos"), F.col("cigar"))
    valid = C.is_valid(F.col("cigar"))
    rows = rows.withColumns({"aligned": aligned & valid, "bad": aligned & ~valid, "kept": sam.kept_tags(F.col("extra"), config.tags)})
    # for records that are not aligned the CIGAR is not looked into
    usable = F.when(F.col("aligned"), F.col("cigar")).otherwise("")
    rows = rows.withColumn("b", C.bounds(usable, F.col("pos")))
    rows = rows.withColumns({"low": F.col("b.low"), "high": F.col("b.high"), "clip0": C.start_clip(usable), "clip1": C.end_clip(usable)}).drop("b")
    size = reference.lengths(sequences).withColumnRenamed("rname", "_r")
    rows = rows.join(size, F.col("rname") == F.col("_r"), "left").drop("_r")
    lo, hi = intervals.footprint_window(F.col("low"), F.col("high"), F.col("clip0"), F.col("clip1"), F.col("ref_length"), config.overrun, config.reclaim)
    rows = rows.withColumns({"lo": lo, "hi": hi})
    can = F.col("aligned") & F.col("ref_length").isNotNull()
    if problems is not None:
        hits = intervals.overlap_extent(rows.filter(can), problems, "ord", "rname", "lo", "hi").withColumnRenamed("ord", "_o")
        rows = rows.join(hits, F.col("ord") == F.col("_o"), "left").drop("_o")
    else:
        rows = rows.withColumns({"hits": F.lit(None).cast("long"), "min_start": F.lit(None).cast("long"), "max_end": F.lit(None).cast("long")})
    wlo, whi = intervals.grow_window(F.col("lo"), F.col("hi"), F.col("low"), F.col("high"), F.col("min_start"), F.col("max_end"), F.col("ref_length"), config.max_expand)
    known = lambda names: F.lit(True) if hasattr(names, "__missing__") else F.col("rname").isin(sorted(names)) if names else F.lit(False)
    note = F.when(F.col("bad"), "malformed CIGAR").when(~F.col("aligned"), "not aligned").when(F.col("ref_length").isNull(), "unknown reference")
    if not config.promiscuous:
        note = note.when(F.col("hits").isNull(), "no problem region")
    note = note.when(~known(costs), "no costs")
    if mangles is not None:
        note = note.when(~known(mangles), "no quality mangles")
    note = note.when((F.col("seq") == "") | (F.col("qual") == ""), "no sequence").otherwise("")
    rows = cut(rows.withColumns({"win_lo": wlo, "win_hi": whi, "note": note}))  # two branches follow

    part = lambda c: F.col(c) if config.reclaim else F.substring(F.col(c), (F.col("clip0") + 1).cast("int"), F.greatest(F.length(c) - F.col("clip0") - F.col("clip1"), n0).cast("int"))
    todo = rows.filter("note = ''").select("ord", "rname", "win_lo", "win_hi", part("seq").alias("read"), part("qual").alias("read_qual"))
    todo = reference.cut_windows(todo, sequences)
    # the kernel takes milliseconds a read, so its rows are spread evenly, whatever the files are like
    todo = todo.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "ord")
    options = Options(config.mode, config.rank, config.count, config.repeats)
    done = todo.select("ord", "rname", "window", "read", "read_qual", "win_lo", "win_hi").mapInPandas(_kernel(costs, mangles, options), f"ord long, alns {_ALN}")
    rows = rows.join(done.withColumnRenamed("ord", "_o"), F.col("ord") == F.col("_o"), "left").drop("_o")

    # what a mate sees of a record: where its main alignment is
    main = F.get(F.filter("alns", lambda x: x["main"]), 0)
    lost = (F.col("note") == "") & (F.coalesce(F.size("alns"), F.lit(0)) == 0)
    ran = (F.col("note") == "") & ~lost
    have = F.when(ran, main["cigar"].contains("M")).when(lost, False).otherwise(F.col("aligned"))
    rows = rows.withColumns({"ran": ran, "lost": lost, "have": F.coalesce(have, F.lit(False))})
    moved = F.col("ran") & F.col("have")
    rows = rows.withColumns({"see_low": F.when(moved, main["pos"]).otherwise(F.col("low")), "see_high": F.when(moved, main["end"]).otherwise(F.col("high") + 1), "needs_pair": sam.needs_pair(F.col("flag"))})
    rows = pairs.with_mates(rows, F.struct("rname", "flag", "have", F.col("see_low").alias("low"), F.col("see_high").alias("high")))

    keep = sam.kept_flags(F.col("flag"))
    clip = lambda n, c: F.when(F.lit(not config.reclaim) & (n > 0), F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    tag = lambda x: F.concat(F.lit("AS:i:"), x["score"].cast("string"), F.when(F.col("kept") == "", "").otherwise(F.concat(F.lit("\t"), "kept")))
    new = F.transform("alns", lambda x: F.struct(keep.bitwiseOR(F.when(x["main"], 0).otherwise(S.SECONDARY)).alias("flag"), F.col("rname").alias("rname"), x["pos"].alias("pos"), F.col("mapq").alias("mapq"), F.concat(clip(F.col("clip0"), 0), x["cigar"], clip(F.col("clip1"), 1)).alias("cigar"), F.lit("").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), n0.alias("tlen"), tag(x).alias("extra"), x["score"].alias("score"), x["pos"].alias("from"), x["end"].alias("to")))
    as_is = lambda rname, pos, mapq, cig: F.array(F.struct(keep.alias("flag"), rname.alias("rname"), pos.cast("long").alias("pos"), mapq.cast("int").alias("mapq"), cig.alias("cigar"), F.col("rnext").alias("rnext"), F.col("pnext").alias("pnext"), F.col("tlen").alias("tlen"), F.col("kept").alias("extra"), F.lit(None).cast("long").alias("score"), F.col("low").alias("from"), F.col("high").alias("to")))
    passed = as_is(F.col("rname"), F.col("pos"), F.col("mapq"), F.col("cigar"))
    unmapped = as_is(F.lit(""), F.lit(-1), F.lit(255), F.lit(""))
    rows = rows.withColumn("out", F.when(F.col("ran"), new).when(F.col("lost"), unmapped).otherwise(passed))
    rows = rows.withColumn("alone", F.size("out") == 1)
    out = rows.select("ord", "file_idx", "qname", "seq", "qual", "have", "alone", "mate", "note", "lost", F.posexplode("out").alias("aln_idx", "r")).select("*", "r.*").drop("r")
    no = ~sam.is_aligned(F.col("flag"), F.col("pos"), F.col("cigar")) | (F.col("alone") & ~F.col("have"))
    out = out.withColumn("flag", F.col("flag").bitwiseOR(F.when(no, S.UNMAPPED).otherwise(0)))
    fields = pairs.mate_fields(F.col("flag"), F.col("from"), F.col("to"), F.col("mate"))
    out = out.withColumns({k: F.when(F.col("mate").isNull(), F.col(k)).otherwise(v) for k, v in fields.items()})
    out = out.withColumn("note", F.when(F.col("lost"), "no alignment").otherwise(F.col("note")))
    out = out.select(*S.SAM.fieldNames(), "aln_idx", "score", "note")
    return out.orderBy("ord", "aln_idx") if config.ordered else out


def output_headers(headers: DataFrame, records: DataFrame) -> DataFrame:
    """The header lines before the first record of the run, and our own program line, which there is only with records."""
    first = records.agg(F.min("ord").alias("first"))
    kept = headers.crossJoin(first).filter(F.col("first").isNull() | (F.col("ord") < F.col("first")))
    own = first.filter("first is not null").select(F.col("first").alias("ord"), F.lit(0).alias("file_idx"), F.lit(PROGRAM).alias("text"))
    return kept.select("ord", "file_idx", "text").unionByName(own)


def realign_files(spark: SparkSession, inputs: list[str], out: str, ref: str, cost: str, prob: str | None = None, qualm: str | None = None, config: Config = Config(), single_file: bool = False) -> None:
    """The whole run, from files to SAM files whose order is that of their names; one file on request, which goes through one task."""
    if prob is None and not config.promiscuous:
        raise ValueError("problem regions are needed, unless the run is promiscuous")
    records, headers = A.read_alignments(spark, inputs)
    result = realign_records(records, Q.read_sequences(spark, ref), K.read_costs(spark, cost), B.read_bed(spark, prob) if prob else None, K.read_mangles(spark, qualm) if qualm else None, config)
    A.write_sam(result, output_headers(headers, records), out, single_file)
