"""The queries of the engine, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import mangle, merge, numeric, quality, sam
from ..functions import text as X
from ..operators import graphs, intervals, order, pairs, regions, suffix, trees
from ..operators.align import GLOBAL, LOCAL, SEMI, Cost, Region, best_scores, cost_grid, fill_many
from ..sources import alignments, sequences, tables
from . import fixtures as T
from . import realign

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_DNA = f"SELECT doc_id, {T.DNA_SQL.format('text')} AS seq FROM documents"


# sequences and qualities


@_query(f"SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc, reverse(seq) AS rq FROM ({_DNA})")
def revcomp(spark, sf):
    seq = T.dna(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", quality.reverse_complement(seq).alias("rc"), quality.reverse_quality(seq).alias("rq"))


@_query("SELECT event_id, round((event_id % 42) / -10.0, 6) + 0.0 AS p FROM events")
def phred_log10(spark, sf):
    char = F.char(33 + F.col("event_id") % 42)
    return T.table(spark, sf, "events").select("event_id", (F.round(quality.phred_to_log10(char), 6) + 0.0).alias("p"))


@_query("SELECT event_id, chr(CAST(trunc(least(greatest(value / 100.0 * 10 + 33, 33.0), 126.0)) AS INT)) AS q FROM events")
def log10_phred(spark, sf):
    return T.table(spark, sf, "events").select("event_id", quality.log10_to_phred(F.col("value") / -100.0).alias("q"))


@_query(f"""WITH d AS ({_DNA}) SELECT doc_id, CAST(len(seq) AS BIGINT) AS n, round(list_sum(list_transform(range(1, len(seq) + 1), lambda i: (ascii(seq[i]) - 33) / -10.0)), 4) AS total,
 array_to_string(list_transform(range(1, len(seq) + 1), lambda i: seq[i]), '') AS again FROM d WHERE len(seq) > 0""")
def phred_arrays(spark, sf):
    seq = T.dna(F.col("text"))
    df = T.table(spark, sf, "documents").select("doc_id", seq.alias("seq")).filter(F.length("seq") > 0).withColumn("p", quality.phreds_to_log10(F.col("seq")))
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x)
    # a hair is added because the way back truncates
    again = quality.log10s_to_phred(F.transform("p", lambda x: x - 1e-9))
    return df.select("doc_id", F.length("seq").cast("long").alias("n"), F.round(total, 4).alias("total"), again.alias("again"))


# CIGAR strings

_CIG = f"""c AS ({T.CIGARS_SQL}),
o AS (SELECT *, list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), lambda x: CAST(x AS BIGINT)) AS n, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS op FROM c),
e AS (SELECT k, pos, cigar, unnest(range(1, len(n) + 1)) AS i, n, op FROM o),
u AS (SELECT k, pos, cigar, i, n[i] AS n, op[i] AS op FROM e),
f AS (SELECT k, pos, cigar, min(i) FILTER (op IN ('M', '=', 'X')) AS m0, max(i) FILTER (op IN ('M', '=', 'X')) AS m1, min(i) FILTER (op NOT IN ('H', 'S', 'P')) AS a0 FROM u GROUP BY k, pos, cigar)"""


@_query(f"""WITH {_CIG} SELECT k, pos, cigar, pos + CAST(coalesce(sum(n) FILTER (i < m0 AND op IN ('D', 'N')), 0) AS BIGINT) AS low,
 pos + CAST(sum(n) FILTER (i <= m1 AND op IN ('M', '=', 'X', 'D', 'N')) AS BIGINT) - 1 AS high FROM u JOIN f USING (k, pos, cigar) GROUP BY k, pos, cigar""")
def cigar_bounds(spark, sf):
    df = T.cigars(spark, sf).withColumn("b", C.bounds(F.col("cigar"), F.col("pos")))
    return df.select("k", "pos", "cigar", "b.low", "b.high")


@_query(f"""WITH {_CIG} SELECT k, pos, cigar, CAST(coalesce(sum(n) FILTER (op = 'S' AND i < a0), 0) AS BIGINT) AS clip0, CAST(coalesce(sum(n) FILTER (op = 'S' AND i > a0), 0) AS BIGINT) AS clip1,
 CAST(sum(n) FILTER (op IN ('M', '=', 'X', 'I')) AS BIGINT) AS read_len FROM u JOIN f USING (k, pos, cigar) GROUP BY k, pos, cigar""")
def cigar_clips(spark, sf):
    c = F.col("cigar")
    return T.cigars(spark, sf).select("k", "pos", "cigar", C.start_clip(c).alias("clip0"), C.end_clip(c).alias("clip1"), C.read_length(c).alias("read_len"))


@_query(f"""WITH {_CIG}, s AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY k, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM u)
SELECT k, pos, cigar, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN op = 'I' THEN -n ELSE n * place + n * (n - 1) // 2 END) AS BIGINT) AS total FROM s WHERE op IN ('M', '=', 'X', 'I') GROUP BY k, pos, cigar""")
def cigar_positions(spark, sf):
    df = T.cigars(spark, sf).withColumn("p", C.positions(F.col("cigar"), F.col("pos")))
    return df.select("k", "pos", "cigar", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


# flags, tags, records

_FLAG = "o_orderkey * 37 % 4096"


def _flags(spark, sf):
    return T.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 4096).cast("int").alias("flag"), (F.col("o_custkey") - 2).alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, "5S").otherwise("5S4X").alias("cigar"))


@_query(f"SELECT o_orderkey, CAST({_FLAG} AS INT) & 2304 = 0 AS p FROM orders")
def flag_primary(spark, sf):
    return _flags(spark, sf).select("o_orderkey", sam.is_primary(F.col("flag")).alias("p"))


@_query(f"SELECT o_orderkey, (({_FLAG}) & 4) = 0 AND (({_FLAG}) & 192) <> 192 AND o_custkey - 2 >= 0 AND o_orderkey % 3 <> 0 AS a FROM orders")
def flag_align(spark, sf):
    return _flags(spark, sf).select("o_orderkey", sam.is_aligned(F.col("flag"), F.col("pos"), F.col("cigar")).alias("a"))


@_query(f"SELECT o_orderkey, (({_FLAG}) & 1) <> 0 AS m FROM orders")
def flag_pair(spark, sf):
    return _flags(spark, sf).select("o_orderkey", sam.needs_pair(F.col("flag")).alias("m"))


@_query(f"SELECT o_orderkey, CAST(({_FLAG}) & 1744 AS INT) AS flag FROM orders WHERE (({_FLAG}) & 2304) = 0")
def dump_as_is(spark, sf):
    return _flags(spark, sf).filter(sam.is_primary(F.col("flag"))).select("o_orderkey", sam.kept_flags(F.col("flag")).alias("flag"))


_TAGS = "['AS:i:' || event_id, 'XT:Z:' || event_type, 'NM:i:' || user_id]"


@_query(f"SELECT event_id, array_to_string(list_filter({_TAGS}, lambda t: starts_with(t, 'NM') OR starts_with(t, 'XT:Z:c')), chr(9)) AS kept FROM events")
def tag_passthrough(spark, sf):
    extra = F.concat(F.lit("AS:i:"), "event_id", F.lit("\tXT:Z:"), "event_type", F.lit("\tNM:i:"), "user_id")
    return T.table(spark, sf, "events").select("event_id", sam.kept_tags(extra, ["NM", "XT:Z:c"]).alias("kept"))


@_query("SELECT o_orderkey AS ord, 'r' || o_custkey AS qname, CAST(o_orderkey % 2048 AS INT) AS flag, o_orderkey - 1 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '4M' END AS cigar, -1 AS pnext, CASE WHEN o_orderkey % 2 = 0 THEN 'NM:i:1' ELSE '' END AS extra FROM orders")
def sam_parse(spark, sf):
    cig = F.when(F.col("o_orderkey") % 5 == 0, "*").otherwise("4M")
    tail = F.when(F.col("o_orderkey") % 2 == 0, F.lit("\tNM:i:1")).otherwise("")
    value = F.concat(F.lit("r"), "o_custkey", F.lit("\t"), F.col("o_orderkey") % 2048, F.lit("\tchr1\t"), "o_orderkey", F.lit("\t60\t"), cig, F.lit("\t*\t0\t0\tACGT\t5555"), tail, F.lit("\r"))
    lines = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.lit(0).alias("file_idx"), value.alias("value"))
    return alignments.parse_sam(lines)[0].select("ord", "qname", "flag", "pos", "cigar", F.col("pnext").cast("int").alias("pnext"), "extra")


@_query("SELECT o_orderkey AS ord, 'r' || o_custkey || chr(9) || CAST(o_orderkey % 2048 AS VARCHAR) || chr(9) || '*' || chr(9) || '0' || chr(9) || '255' || chr(9) || '4M' || chr(9) || '=' || chr(9) || o_orderkey || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || CASE WHEN o_orderkey % 2 = 0 THEN chr(9) || 'AS:i:3' ELSE '' END AS line FROM orders")
def sam_write(spark, sf):
    f = lambda v, n: F.lit(v).alias(n)
    rows = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("r"), "o_custkey").alias("qname"), (F.col("o_orderkey") % 2048).cast("int").alias("flag"), f("", "rname"), F.lit(-1).cast("long").alias("pos"), f(255, "mapq"), f("4M", "cigar"), f("=", "rnext"), (F.col("o_orderkey") - 1).alias("pnext"), F.lit(0).cast("long").alias("tlen"), f("", "seq"), f("", "qual"), F.when(F.col("o_orderkey") % 2 == 0, "AS:i:3").otherwise("").alias("extra"))
    return rows.select("ord", alignments.sam_line().alias("line"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS ord, '@' || n_name AS text FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 10, '" + realign.PROGRAM.replace("\t", "' || chr(9) || '") + "'")
def header_passthrough(spark, sf):
    n = T.table(spark, sf, "nation")
    heads = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.lit(0).alias("file_idx"), F.concat(F.lit("@"), "n_name").alias("text"))
    rows = n.filter("n_nationkey >= 10").select(F.col("n_nationkey").cast("long").alias("ord"))
    return realign.output_headers(heads, rows).select("ord", "text")


# text formats


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN '' ELSE 'chr' || s_nationkey END AS chrom, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN -1 ELSE s_suppkey END AS start, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN -1 WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey * 2 END AS \"end\", CASE WHEN s_suppkey % 7 = 0 THEN 'no colon' WHEN s_suppkey % 11 = 0 THEN 'illegal character' ELSE '' END AS error FROM supplier")
def ucsc_parse(spark, sf):
    k = F.col("s_suppkey")
    place = F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("-"), (k * 2).cast("string")))
    text = F.when(k % 7 == 0, F.concat(F.lit("chr"), "s_nationkey")).when(k % 11 == 0, F.concat(F.lit("chr"), "s_nationkey", F.lit(":x"), k)).otherwise(F.concat(F.lit("chr"), "s_nationkey", F.lit(":"), place))
    return T.table(spark, sf, "supplier").select("s_suppkey", X.ucsc(text).alias("u")).select("s_suppkey", "u.*")


@_query("SELECT 'c' || s_nationkey AS chrom, CASE WHEN s_suppkey % 9 = 4 THEN 0 ELSE s_suppkey END AS start, s_suppkey + 10 AS \"end\" FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 1")
def bed_scan(spark, sf):
    k = F.col("s_suppkey")
    start = F.when(k % 9 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit("z")))
    line = F.concat(F.when(k % 5 == 0, "#").otherwise(""), F.lit("c"), "s_nationkey", F.lit("\t"), start, F.when(k % 6 == 1, "").otherwise(F.concat(F.lit("\t"), (k + 10).cast("string"), F.lit("\textra\r"))))
    return tables.parse_bed(T.table(spark, sf, "supplier").select(tables.cells(line).alias("cells")))


@_query("SELECT s_suppkey, len(c) AS n, c[1] AS first, c[len(c)] AS last FROM (SELECT s_suppkey, string_split(replace(s_name || chr(9) || chr(9) || chr(13) || s_nationkey || chr(9), chr(13), ''), chr(9)) AS c FROM supplier)")
def tsv_split(spark, sf):
    line = F.concat("s_name", F.lit("\t\t\r"), "s_nationkey", F.lit("\t"))
    return T.table(spark, sf, "supplier").select("s_suppkey", tables.cells(line).alias("c")).select("s_suppkey", F.size("c").cast("long").alias("n"), F.get("c", 0).alias("first"), F.element_at("c", -1).alias("last"))


@_query("SELECT c_custkey, c_name || chr(9) || c_mktsegment || '\\' || chr(10) AS cell FROM customer")
def tsv_escapes(spark, sf):
    cell = F.concat("c_name", F.lit("\t"), "c_mktsegment", F.lit("\\\n"))
    return T.table(spark, sf, "customer").select("c_custkey", X.unescape(X.escape(cell)).alias("cell"))


@_query("SELECT p_partkey, CAST(length(regexp_extract(p_name, '^([a-z]*)', 1)) AS BIGINT) AS span, CAST(CASE WHEN instr(p_type, 'E') = 0 THEN length(p_type) ELSE instr(p_type, 'E') - 1 END AS BIGINT) AS until, CAST(CASE WHEN instr(p_name, p_brand) = 0 THEN length(p_name) ELSE instr(p_name, p_brand) - 1 END AS BIGINT) AS at, CAST(len(regexp_split_to_array(p_type, '[ EA]')) AS BIGINT) AS parts FROM part")
def text_spans(spark, sf):
    n, t = F.col("p_name"), F.col("p_type")
    return T.table(spark, sf, "part").select("p_partkey", X.span_of(n, "abcdefghijklmnopqrstuvwxyz").cast("long").alias("span"), X.span_until(t, "E").cast("long").alias("until"), X.find(n, F.col("p_brand")).cast("long").alias("at"), F.size(X.split_any(t, " EA")).cast("long").alias("parts"))


@_query("SELECT n_nationkey, n_name AS name, regexp_extract(n_name, '^(\\S*)', 1) AS short_name, upper(n_name) || 'ACGT' AS seq FROM nation")
def fasta_parse(spark, sf):
    rec = F.concat("n_name", F.lit("\r\n"), F.upper("n_name"), F.lit("\n AC\r\nGT\n"))
    rows = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), rec.alias("value"))
    return sequences.parse_fasta(rows).select(F.col("ord").alias("n_nationkey"), "name", "short_name", F.regexp_replace("seq", " ", "").alias("seq"))


@_query(f"SELECT 'd' || doc_id AS rname, CAST(length(seq) AS BIGINT) AS ref_length FROM ({_DNA})")
def reference_lengths(spark, sf):
    from ..operators import reference

    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("short_name"), T.dna(F.col("text")).alias("seq"))
    return reference.lengths(docs)


# intervals, pairs, order

_OVERLAP = 'f.chrom = r.chrom AND r.start < f.hi AND r."end" > f.lo'


@_query(f'WITH f AS ({T.FOOTPRINTS_SQL}), r AS ({T.REGIONS_SQL}) SELECT f.k, r.rid FROM f JOIN r ON {_OVERLAP}')
def interval_overlap_join(spark, sf):
    return intervals.overlap_join(T.footprints(spark, sf), T.regions(spark, sf)).select("k", "rid")


@_query(f'WITH f AS ({T.FOOTPRINTS_SQL}), r AS ({T.REGIONS_SQL}) SELECT f.k, count(*) AS hits, min(r.start) AS min_start, max(r."end") AS max_end FROM f JOIN r ON {_OVERLAP} GROUP BY f.k')
def interval_extent(spark, sf):
    return intervals.overlap_extent(T.footprints(spark, sf), T.regions(spark, sf), "k")


@_query(f"""WITH f AS ({T.FOOTPRINTS_SQL}), r AS ({T.REGIONS_SQL}),
w AS (SELECT k, chrom, lo AS low, hi - 1 AS high, greatest(lo - 20 - 3, 0) AS lo, least(hi - 1 + 20 + 2, 15000 - 1) + 1 AS hi FROM f),
h AS (SELECT f.k, min(r.start) AS s, max(r."end") AS e FROM w f JOIN r ON {_OVERLAP} GROUP BY f.k)
SELECT k, greatest(greatest(least(lo, coalesce(s, lo)), low - 100), 0) AS win_lo, least(least(greatest(hi, coalesce(e, hi)), high + 1 + 100), 15000) AS win_hi FROM w LEFT JOIN h USING (k)""")
def window_expand(spark, sf):
    size = F.lit(15000).cast("long")
    f = T.footprints(spark, sf).select("k", "chrom", F.col("lo").alias("low"), (F.col("hi") - 1).alias("high"))
    lo, hi = intervals.footprint_window(F.col("low"), F.col("high"), F.lit(3), F.lit(2), size, 20, 1)
    f = f.withColumns({"lo": lo, "hi": hi})
    ext = intervals.overlap_extent(f, T.regions(spark, sf), "k").withColumnRenamed("k", "_k")
    f = f.join(ext, F.col("k") == F.col("_k"), "left")
    lo, hi = intervals.grow_window(F.col("lo"), F.col("hi"), F.col("low"), F.col("high"), F.col("min_start"), F.col("max_end"), size, 100)
    return f.select("k", lo.alias("win_lo"), hi.alias("win_hi"))


@_query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT a.o_orderkey AS first, b.o_orderkey AS second, a.o_custkey AS qname FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.n % 2 = 0 AND b.n = a.n + 1""")
def pair_join(spark, sf):
    return pairs.pair_rows(T.table(spark, sf, "orders").select(F.col("o_custkey").alias("qname"), F.col("o_orderkey").alias("ord")))


@_query("""WITH o AS (SELECT o_orderkey AS ord, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(o_orderkey * 37 % 4096 & 1744 | CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 0 END AS INT) AS flag, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 10 + o_orderkey % 13 AS hi FROM orders),
p AS (SELECT a.*, b.ord AS mo, b.flag AS mf, b.lo AS ml, b.hi AS mh, b.ord % 6 <> 0 AS have FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.n = CASE WHEN a.n % 2 = 0 THEN a.n + 1 ELSE a.n - 1 END)
SELECT ord, CAST(flag | 1 | CASE WHEN have THEN CASE WHEN flag & 4 = 0 THEN 2 ELSE 0 END ELSE 8 END | CASE WHEN mf & 16 <> 0 THEN 32 ELSE 0 END AS INT) AS flag,
 CASE WHEN have THEN 'c' || mo % 3 ELSE '' END AS rnext, CASE WHEN have THEN ml ELSE -1 END AS pnext,
 CASE WHEN have AND flag & 4 = 0 THEN (greatest(hi, mh) - least(lo, ml)) * CASE WHEN lo < ml OR (lo = ml AND hi < mh) THEN 1 ELSE -1 END ELSE 0 END AS tlen FROM p""")
def pair_fields(spark, sf):
    k = F.col("o_orderkey")
    unmapped = F.when(k % 6 == 0, 4).otherwise(0)
    o = T.table(spark, sf, "orders").select(k.alias("ord"), F.col("o_custkey").alias("qname"), sam.kept_flags((k * 37 % 4096).cast("int")).bitwiseOR(unmapped).alias("flag"), (k % 1000).alias("lo"), (k % 1000 + 10 + k % 13).alias("hi"), F.concat(F.lit("c"), k % 3).alias("rname"), (k % 6 != 0).alias("have"), F.lit(True).alias("needs_pair"))
    o = pairs.with_mates(o, F.struct("rname", "flag", "have", F.col("lo").alias("low"), F.col("hi").alias("high"))).filter("mate is not null")
    f = pairs.mate_fields(F.col("flag"), F.col("lo"), F.col("hi"), F.col("mate"))
    return o.select("ord", *[v.alias(k) for k, v in f.items()])


@_query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC) - 1 AS INT) AS rank FROM lineitem) WHERE rank < 2")
def topk_distinct_scores(spark, sf):
    return order.top_scores(T.table(spark, sf, "lineitem"), ["l_orderkey"], "l_tax", 2).select("l_orderkey", "l_linenumber", "rank")


@_query("SELECT l_orderkey, l_linenumber, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_tax FROM lineitem)) WHERE n <= 3")
def cap_count(spark, sf):
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax").distinct()
    return order.cap_alternatives(rows, ["l_orderkey"], "l_tax", "l_linenumber", 3)


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_no FROM orders")
def order_restore(spark, sf):
    return order.number_rows(T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_no")


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey")
def mergesort(spark, sf):
    return order.sort_rows(T.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey")


@_query("SELECT s.x, (SELECT count(*) FROM customer WHERE c_acctbal < s.x) AS lower, (SELECT count(*) FROM customer WHERE c_acctbal <= s.x) AS upper FROM (SELECT DISTINCT s_acctbal AS x FROM supplier) s")
def sorted_bounds(spark, sf):
    probes = T.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"))
    return order.bound_counts(T.table(spark, sf, "customer"), probes, "c_acctbal", "x")


# alignment scores

_COST = Cost(-3, -1, -2, (65, 67, 71, 84), ((2, -3, -3, -3), (-3, 2, -3, -3), (-3, -3, 2, -3), (-3, -3, -3, 2)))


def _scores(spark, sf, mode):
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            pairs_ = list(zip(batch["a"], batch["b"], strict=True))
            for i in range(0, len(pairs_), 256):
                problems = [(a, b, cost_grid([Region(None, None, None, None, _COST)], len(a), len(b))) for a, b in pairs_[i : i + 256]]
                out += [best_scores(t, 1)[0] for t in fill_many(problems, mode)]
            yield pd.DataFrame({"p_partkey": batch["p_partkey"], "score": out})

    rows = T.table(spark, sf, "part").select("p_partkey", T.dna(F.col("p_name")).alias("a"), T.dna(F.col("p_type")).alias("b"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "p_partkey")
    return rows.mapInPandas(run, "p_partkey long, score long")


def _score_sql(mode: str) -> str:
    """Rows of the three tables as lists, one step of the recursion a reference base; the gap along a row is a maximum over its starts."""
    border_b = {GLOBAL: "list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN -1000000 ELSE -3 - j END)", SEMI: "list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN -1000000 ELSE 0 END)", LOCAL: "list_transform(range(0, n + 1), lambda j: -1000000)"}[mode]
    border_a = {GLOBAL: "-3 - (i + 1)", SEMI: "0", LOCAL: "-1000000"}[mode]
    free = "-2" if mode == GLOBAL else "CASE WHEN i = 0 OR j = 1 THEN 0 ELSE -2 END"
    zero = ", 0" if mode == LOCAL else ""
    best = {
        GLOBAL: "greatest(tm[n + 1], ta[n + 1] - 2, tb[n + 1] - 2)",
        SEMI: "greatest(best, CASE WHEN i < m THEN greatest(CASE WHEN i > 0 THEN tm[n + 1] ELSE -1000000 END, tb[n + 1] + CASE WHEN i > 0 THEN -2 ELSE 0 END) ELSE list_max(list_transform(range(0, n + 1), lambda j: greatest(CASE WHEN j > 0 THEN tm[j + 1] ELSE -1000000 END, ta[j + 1] + CASE WHEN j > 0 THEN -2 ELSE 0 END))) END)",
        LOCAL: "greatest(best, list_max(list_transform(range(1, n + 1), lambda j: tm[j + 1])))",
    }[mode]
    gap_a = "greatest(tm[j + 1] - 4, ta[j + 1] - 1, tb[j + 1] + {f} - 4)".format(f=free)
    if mode == SEMI:
        gap_a = f"CASE WHEN i = 0 THEN tb[j + 1] - 4 ELSE {gap_a} END"
    return f"""WITH RECURSIVE d AS (SELECT p_partkey, {T.DNA_SQL.format("p_name")} AS a, {T.DNA_SQL.format("p_type")} AS b FROM part),
s AS (SELECT *, len(a) AS m, len(b) AS n FROM d),
r AS (
  SELECT p_partkey, a, b, m, n, 0 AS i, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -1000000 END) AS tm, list_transform(range(0, n + 1), lambda j: -1000000) AS ta, {border_b} AS tb, -1000000 AS best FROM s
  UNION ALL
  SELECT p_partkey, a, b, m, n, i + 1, tm2, ta2, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN -1000000 ELSE list_max(list_transform(range(0, j), lambda k: greatest(tm2[k + 1], ta2[k + 1] + {"-2" if mode == GLOBAL else "CASE WHEN i = 0 OR k = 0 THEN 0 ELSE -2 END"}) - 3 - (j - k))) END), best2
  FROM (SELECT *,
    list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN -1000000 ELSE greatest(tm[j], ta[j] + {free}, tb[j] + {free}{zero}) + CASE WHEN a[i + 1] = b[j] THEN 2 ELSE -3 END END) AS tm2,
    list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN {border_a} ELSE {gap_a} END) AS ta2,
    {best} AS best2
    FROM r WHERE i < m))
SELECT p_partkey, CAST({best} AS BIGINT) AS score FROM r WHERE i = m"""


@_query()
def score_global(spark, sf):
    return _scores(spark, sf, GLOBAL)


@_query()
def score_semi(spark, sf):
    return _scores(spark, sf, SEMI)


@_query()
def score_local(spark, sf):
    return _scores(spark, sf, LOCAL)


_SQL |= {"score_global": _score_sql(GLOBAL), "score_semi": _score_sql(SEMI), "score_local": _score_sql(LOCAL)}


@_query()
def realign_best(spark, sf):
    """The whole plan: reads and references from documents, problem regions around every thousandth base, costs that forgive gaps there."""
    recs, seqs = T.records(spark, sf)
    soft = Cost(-2, -1, 0, _COST.chars, _COST.mm)
    costs = _SameCosts([Region(None, None, None, None, _COST), Region(0, 1 << 40, 0, 1 << 40, soft)])
    spots = seqs.select(F.col("short_name").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - 1, F.lit(0)).cast("long"), F.lit(1000).cast("long"))).alias("start"))
    spots = spots.select("chrom", "start", (F.col("start") + 400).alias("end"))
    config = realign.Config(rank=1, count=2, tags=["NM"])
    return realign.realign_records(recs, seqs, costs, spots, None, config)


class _SameCosts(dict):
    """The same cost regions for every reference."""

    def __init__(self, regions: list[Region]):
        super().__init__()
        self.regions = regions

    def __missing__(self, name: str) -> list[Region]:
        return self.regions

    def __reduce__(self):
        return _SameCosts, (self.regions,)


# cost regions


def _points(spark, sf):
    return T.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).cast("long").alias("chrom"), (F.col("s_suppkey") * 37 % 2000 * 10).alias("x"), (F.col("s_suppkey") % 30).alias("y"))


def _boxes(spark, sf):
    p, k = T.table(spark, sf, "part"), F.col("p_partkey")
    bounded = k % 3 == 0
    return p.select((F.col("p_size") % 5).cast("long").alias("chrom"), k.alias("idx"), (k * 10 - 200).alias("start_a"), (k * 10 + 300).alias("end_a"), F.when(bounded, k % 7).alias("start_b"), F.when(bounded, k % 7 + 20).alias("end_b"), bounded.cast("int").alias("priority"), (-(k % 9)).alias("cost"))


_POINTS_SQL = "SELECT s_suppkey, s_suppkey % 5 AS chrom, s_suppkey * 37 % 2000 * 10 AS x, s_suppkey % 30 AS y FROM supplier"
_BOXES_SQL = "SELECT p_size % 5 AS chrom, p_partkey AS idx, p_partkey * 10 - 200 AS start_a, p_partkey * 10 + 300 AS end_a, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 END AS start_b, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 + 20 END AS end_b, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS priority, -(p_partkey % 9) AS cost FROM part"


@_query(f"""WITH p AS ({_POINTS_SQL}), r AS ({_BOXES_SQL}), h AS (SELECT s_suppkey, cost, row_number() OVER (PARTITION BY s_suppkey ORDER BY priority DESC, idx DESC) AS n FROM p JOIN r ON p.chrom = r.chrom AND start_a <= x AND x < end_a AND (start_b IS NULL OR (start_b <= y AND y < end_b)))
SELECT p.s_suppkey, cost FROM p LEFT JOIN h ON p.s_suppkey = h.s_suppkey AND n = 1""")
def cost_region_lookup(spark, sf):
    return regions.cost_at(_points(spark, sf), _boxes(spark, sf), "s_suppkey")


@_query(f"""WITH p AS ({_POINTS_SQL}), r AS ({_BOXES_SQL}) SELECT s_suppkey, idx, greatest(start_a - x, 0) AS start_a, least(end_a - x, 100) AS end_a FROM p JOIN r ON p.chrom = r.chrom AND start_a < x + 100 AND end_a > x""")
def cost_rebase(spark, sf):
    w = _points(spark, sf).select("s_suppkey", "chrom", F.col("x").alias("lo"), (F.col("x") + 100).alias("hi"))
    return regions.rebase_regions(w, _boxes(spark, sf)).select("s_suppkey", "idx", "start_a", "end_a")


@_query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey - l_partkey + l_linenumber) * -3 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN l_partkey ELSE CAST(trunc(v / 2.0) AS BIGINT) - 7 END AS v FROM t""")
def mangle_script(spark, sf):
    op = lambda o, a: F.struct(F.lit(o).alias("op"), a.cast("long").alias("arg"))
    start = [op("+", F.col("l_linenumber")), op("*", F.lit(-3)), op("/", F.lit(2)), op("-", F.lit(7))]
    ops = F.when(F.col("l_partkey") % 5 == 0, F.array(*start, op("=", F.col("l_partkey")))).otherwise(F.array(*start))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mangle.apply_script(F.col("l_suppkey") - F.col("l_partkey"), ops).alias("v"))


_QUAL_SQL = "SELECT s_suppkey, s_suppkey % 5 AS chrom, repeat(chr(CAST(40 + s_suppkey % 3 AS INT)), 4) || repeat(chr(CAST(40 + s_suppkey % 2 AS INT)), 3) || repeat('F', CAST(s_suppkey % 4 AS INT)) AS qual FROM supplier"


def _quals(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select("s_suppkey", (k % 5).alias("chrom"), F.concat(F.repeat(F.char(40 + k % 3), F.lit(4)), F.repeat(F.char(40 + k % 2), F.lit(3)), F.repeat(F.lit("F"), (k % 4).cast("int"))).alias("qual"))


_RUNS = f"""q AS ({_QUAL_SQL}), c AS (SELECT s_suppkey, chrom, unnest(range(0, len(qual))) AS i, qual FROM q), b AS (SELECT s_suppkey, chrom, i, ascii(qual[i + 1]) AS q FROM c),
g AS (SELECT *, i - row_number() OVER (PARTITION BY s_suppkey, q ORDER BY i) AS isle FROM b), runs AS (SELECT s_suppkey, chrom, min(i) AS start, max(i) + 1 AS "end", q FROM g GROUP BY s_suppkey, chrom, q, isle)"""


@_query(f'WITH {_RUNS} SELECT s_suppkey, start, "end", q FROM runs')
def quality_runs(spark, sf):
    return regions.quality_runs(_quals(spark, sf), "s_suppkey")


def _mangles(spark):
    return spark.sql("SELECT * FROM VALUES (0L, 1, 40, 40), (0L, 2, 39, 41), (1L, 3, 41, 60), (3L, 4, 70, 70) AS t(chrom, mangle, q_lo, q_hi)")


@_query(f"""WITH {_RUNS}, m AS (SELECT * FROM (VALUES (0, 1, 40, 40), (0, 2, 39, 41), (1, 3, 41, 60), (3, 4, 70, 70)) t(chrom, mangle, q_lo, q_hi)),
x AS (SELECT s_suppkey, runs.chrom, start, "end", q, min(mangle) AS mangle FROM runs LEFT JOIN m ON runs.chrom = m.chrom AND q BETWEEN q_lo AND q_hi GROUP BY ALL), r AS ({_BOXES_SQL})
SELECT s_suppkey, idx, start_a, end_a, greatest(start, coalesce(start_b, start)) AS start_b, least("end", coalesce(end_b, "end")) AS end_b, q, mangle FROM x JOIN r ON x.chrom = r.chrom AND (start_b IS NULL OR start_b < "end") AND (end_b IS NULL OR end_b > start)""")
def mangled_regions(spark, sf):
    return regions.mangled_regions(_quals(spark, sf), _boxes(spark, sf), _mangles(spark), "s_suppkey")


@_query("""WITH p AS (SELECT o_orderkey, CAST(33 + o_orderkey % 42 AS INT) AS qa, CAST(33 + o_custkey % 42 AS INT) AS qb FROM orders),
r AS (SELECT * FROM (VALUES (1, NULL, NULL, NULL, NULL), (2, 40, NULL, NULL, NULL), (3, 40, 60, NULL, 50), (4, NULL, 70, 35, 50), (5, 36, 50, 36, 50)) t(rule, a_lo, a_hi, b_lo, b_hi)),
h AS (SELECT o_orderkey, rule, row_number() OVER (PARTITION BY o_orderkey ORDER BY (a_lo IS NOT NULL)::INT + (a_hi IS NOT NULL)::INT + (b_lo IS NOT NULL)::INT + (b_hi IS NOT NULL)::INT DESC, rule) AS n
 FROM p JOIN r ON (a_lo IS NULL OR a_lo <= qa) AND (a_hi IS NULL OR qa <= a_hi) AND (b_lo IS NULL OR b_lo <= qb) AND (b_hi IS NULL OR qb <= b_hi))
SELECT o_orderkey, rule FROM h WHERE n = 1""")
def quality_pair_rules(spark, sf):
    p = T.table(spark, sf, "orders").select("o_orderkey", (33 + F.col("o_orderkey") % 42).alias("qa"), (33 + F.col("o_custkey") % 42).alias("qb"))
    rules = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT)), (2, 40, NULL, NULL, NULL), (3, 40, 60, NULL, 50), (4, NULL, 70, 35, 50), (5, 36, 50, 36, 50) AS t(rule, a_lo, a_hi, b_lo, b_hi)")
    return regions.quality_pair_rules(p, rules, "o_orderkey")


# numbers


@_query("WITH e AS (SELECT event_type, value / -100.0 AS x, max(value / -100.0) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, round(any_value(m) + log10(sum(power(10.0, x - m))), 6) AS total FROM e GROUP BY event_type")
def log_sum_exp(spark, sf):
    e = T.table(spark, sf, "events").select("event_type", (F.col("value") / -100.0).alias("x"))
    return numeric.log10_sum_by(e, ["event_type"], "x", "total").select("event_type", F.round("total", 6).alias("total"))


@_query("SELECT vec_id, round(list_max(e) + log10(list_sum(list_transform(e, lambda x: power(10.0, x - list_max(e))))), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def log_sum_array(spark, sf):
    v = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", F.round(numeric.log10_sum(F.col("e")), 6).alias("total"))


@_query("SELECT p_partkey, round(lgamma(p_retailprice / 100.0 + p_size), 5) AS g FROM part")
def log_gamma(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", F.round(numeric.log_gamma(F.col("p_retailprice") / 100.0 + F.col("p_size")), 5).alias("g"))


_PAIR_SQL = "SELECT event_id, substr('ACGT', CAST(event_id % 4 + 1 AS INT), 1) AS a, substr('ACGT', CAST(user_id % 4 + 1 AS INT), 1) AS b, -(event_id % 40 + 1) / 10.0 AS qa, -(user_id % 37 + 1) / 10.0 AS qb FROM events"


@_query(f"""WITH p AS ({_PAIR_SQL}), w AS (SELECT event_id, a = b AS same, CASE WHEN qa < qb THEN a ELSE b END AS base, power(10.0, CASE WHEN qa < qb THEN qa ELSE qb END) AS w, power(10.0, CASE WHEN qa < qb THEN qb ELSE qa END) AS x FROM p)
SELECT event_id, base, round(CASE WHEN same THEN log10((w * x / 3) / (1 - w - x + 4 * w * x / 3)) ELSE log10(w * (1 - x / 3) / (w + x - 4 * w * x / 3)) END, 6) AS qual FROM w""")
def merge_overlap(spark, sf):
    e = T.table(spark, sf, "events")
    pick = lambda c: F.substring(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    pair = F.struct(pick("event_id").alias("a"), (-(F.col("event_id") % 40 + 1) / 10.0).alias("qa"), pick("user_id").alias("b"), (-(F.col("user_id") % 37 + 1) / 10.0).alias("qb"))
    m = e.select("event_id", F.explode(merge.merge_overlap(F.array(pair))).alias("m"))
    return m.select("event_id", "m.base", F.round("m.qual", 6).alias("qual"))


@_query(f"""WITH d AS (SELECT p_partkey, {T.DNA_SQL.format("p_name")} AS a, {T.DNA_SQL.format("p_type")} AS b FROM part), n AS (SELECT *, least(len(a), len(b)) AS n FROM d),
s AS (SELECT p_partkey, a, b, n, CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN a[i] = b[i] THEN log10(1 - power(10.0, -2.0)) ELSE -2.0 + log10(1.0 / 3) END)) END AS p FROM n)
SELECT p_partkey, round(CASE WHEN n = 0 THEN -4.0 + len(b) * -0.5 ELSE p + CASE WHEN len(b) > n THEN -4.0 + (len(b) - n) * -0.5 ELSE 0 END END, 6) AS p FROM s""")
def alignment_log10(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", T.dna(F.col("p_name")).alias("a"), T.dna(F.col("p_type")).alias("b"))
    path = F.sequence(F.lit(0), F.least(F.length("a"), F.length("b")))
    q = F.array_repeat(F.lit(-2.0), F.length("b"))
    return p.select("p_partkey", F.round(merge.alignment_log10(path, path, F.col("a"), F.col("b"), q, -4.0, -0.5), 6).alias("p"))


# suffixes, graphs, trees


@_query("""WITH s AS (SELECT item_id, unnest(range(0, length(text) + 1)) AS pos, text FROM benchmark)
SELECT item_id, pos, dense_rank() OVER (ORDER BY substr(text, CAST(pos + 1 AS INT))) - 1 AS rank FROM s""")
def suffix_array(spark, sf):
    return suffix.suffix_array(T.table(spark, sf, "benchmark"), "item_id").select("item_id", F.col("pos").cast("long").alias("pos"), "rank")


_TERMS = "VALUES ('the'), ('an'), ('er'), ('zz'), ('T'), ('ion ')"


@_query(f"""WITH s AS (SELECT unnest(range(0, length(text) + 1)) AS pos, text FROM benchmark), x AS (SELECT substr(text, CAST(pos + 1 AS INT)) AS x FROM s), q AS (SELECT * FROM ({_TERMS}) t(q))
SELECT q, count(*) FILTER (x < q) AS lower, count(*) FILTER (x < q OR starts_with(x, q)) AS upper FROM q, x GROUP BY q""")
def suffix_search(spark, sf):
    terms = spark.sql(f"SELECT * FROM {_TERMS} AS t(q)")
    return suffix.prefix_bounds(T.table(spark, sf, "benchmark"), terms, "item_id", "q")


def _halving(spark, sf):
    """Customers, each with an edge to the customer of half its number."""
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return c, c.filter("node > 1").select(F.col("node").alias("src"), F.expr("node div 2").alias("dst"))


_HALF = "e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1)"


@_query(f"""WITH RECURSIVE {_HALF}, both_ AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT s_suppkey * 10 AS node, 0 AS h FROM supplier UNION SELECT b, h + 1 FROM r JOIN both_ ON a = node WHERE h < 2) SELECT DISTINCT node FROM r""")
def graph_khop(spark, sf):
    _, edges = _halving(spark, sf)
    return graphs.neighbourhood(edges, T.table(spark, sf, "supplier").select((F.col("s_suppkey") * 10).alias("node")), 2)


@_query(f"WITH RECURSIVE {_HALF}, r AS (SELECT c_custkey AS node, 0 AS lvl FROM customer UNION SELECT dst, lvl + 1 FROM r JOIN e ON src = node) SELECT node, CAST(max(lvl) AS INT) AS level, false AS cyclic FROM r GROUP BY node")
def graph_topo(spark, sf):
    return graphs.topological_levels(*_halving(spark, sf))


@_query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 7 = 6 THEN s_suppkey - 6 ELSE s_suppkey + 1 END AS dst FROM supplier UNION SELECT s_suppkey, s_suppkey + 7 FROM supplier WHERE s_suppkey % 5 = 0),
f AS (SELECT * FROM e WHERE src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT s_suppkey FROM supplier)),
r AS (SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION SELECT a, dst FROM r JOIN f ON b = src)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def graph_components(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    k = F.col("node")
    ring = s.select(k.alias("src"), F.when(k % 7 == 6, k - 6).otherwise(k + 1).alias("dst"))
    e = ring.unionByName(s.filter(k % 5 == 0).select(k.alias("src"), (k + 7).alias("dst")))
    e = e.join(s.select(k.alias("src")), "src", "left_semi").join(s.select(k.alias("dst")), "dst", "left_semi").select("src", "dst")
    return graphs.strong_components(s, e)


@_query("""WITH g AS (SELECT n_name AS graph, length(n_name) AS n FROM nation), j AS (SELECT graph, unnest(range(0, n - 1)) AS src, n FROM g)
SELECT graph, src, src + 1 AS dst FROM j UNION SELECT graph, 0, n - 1 FROM g UNION SELECT graph, i, i FROM (SELECT graph, unnest(range(0, n)) AS i FROM g)""")
def graph_flatten(spark, sf):
    n = T.table(spark, sf, "nation").select(F.col("n_name").alias("graph"), F.col("n_name").alias("seq"))
    last = F.length("seq").cast("long") - 1
    step = F.transform(F.sequence(F.lit(0).cast("long"), last - 1), lambda i: F.struct(i.alias("src"), (i + 1).alias("dst")))
    g = n.withColumn("edges", F.concat(step, F.array(F.struct(F.lit(0).cast("long").alias("src"), last.alias("dst")))))
    return graphs.flatten_graphs(g)


@_query("""WITH v AS (SELECT label, unnest(range(0, 64)) AS dim, embedding FROM embeddings), u AS (SELECT label, dim, CAST(embedding[dim + 1] AS DOUBLE) AS val FROM v),
k AS (SELECT DISTINCT dim, val FROM u), c AS (SELECT dim, val, label, count(*) AS n FROM u GROUP BY ALL), l AS (SELECT DISTINCT label FROM u),
g AS (SELECT k.dim, k.val, l.label, coalesce(n, 0) AS n FROM k CROSS JOIN l LEFT JOIN c ON c.dim = k.dim AND c.val = k.val AND c.label = l.label),
r AS (SELECT dim, val, sum(n) OVER (PARTITION BY dim, label ORDER BY val) AS lo, sum(n) OVER (PARTITION BY dim, label) AS al FROM g),
t AS (SELECT dim, val, sum(lo) AS nl, sum(al - lo) AS nh, sum(lo * lo) AS sl, sum((al - lo) * (al - lo)) AS sh FROM r GROUP BY dim, val)
SELECT CAST(dim AS INT) AS dim, val, round(((1 - sl / (nl * nl)) + CASE WHEN nh = 0 THEN 0 ELSE 1 - sh / (nh * nh) END) / 2, 9) AS score FROM t""")
def gini_split(spark, sf):
    e = T.table(spark, sf, "embeddings")
    names = [f"x{i}" for i in range(64)]
    e = e.select("label", *[F.get("embedding", i).alias(n) for i, n in enumerate(names)])
    s = trees.split_scores(e, names, "label", sorted(r[0] for r in e.select("label").distinct().collect()))
    return s.select("dim", "val", F.round("score", 9).alias("score"))


@_query("SELECT l_suppkey, l_linenumber AS vote FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS n FROM lineitem GROUP BY 1, 2) WHERE n = 1")
def leaf_vote(spark, sf):
    return trees.majority(T.table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber")


@_query("SELECT l_suppkey, l_linenumber AS vote FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber DESC) AS n FROM lineitem GROUP BY 1, 2) WHERE n = 1")
def forest_vote(spark, sf):
    return trees.majority(T.table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", last=True)


@_query()
def forest_classify(spark, sf):
    """A forest on all components of the embeddings, and the class that most trees give."""
    names = [f"x{i}" for i in range(64)]
    e = T.table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", i).alias(n) for i, n in enumerate(names)])
    forest = trees.grow_forest(e, names, "label", classes=10).cache()
    return trees.forest_classes(trees.apply_forest(e, forest, names, "vec_id", add="votes"), "vec_id")


@_query()
def forest_regress(spark, sf):
    names = ["c_custkey", "c_nationkey"]
    c = T.table(spark, sf, "customer").filter("c_nationkey is not null")
    forest = trees.grow_forest(c, names, "c_acctbal").cache()
    return trees.forest_means(trees.apply_forest(c, forest, names, "c_custkey", add="sum"), "c_custkey", 1024)


@_query("""WITH s AS (SELECT label, min(CAST(embedding[1] AS DOUBLE)) AS a0, max(CAST(embedding[1] AS DOUBLE)) AS b0, min(CAST(embedding[2] AS DOUBLE)) AS a1, max(CAST(embedding[2] AS DOUBLE)) AS b1 FROM embeddings GROUP BY label)
SELECT label, CASE WHEN b1 - a1 > b0 - a0 THEN 1 ELSE 0 END AS dim, round(CASE WHEN b1 - a1 > b0 - a0 THEN (b1 + a1) / 2 ELSE (b0 + a0) / 2 END, 9) AS val FROM s""")
def kd_midpoint_split(spark, sf):
    e = T.table(spark, sf, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return trees.kd_split(e, ["x", "y"], ["label"]).select("label", "dim", F.round("val", 9).alias("val"))


@_query()
def kd_tree(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return trees.kd_tree(e, ["x", "y"], "vec_id")[1]


@_query("SELECT p_brand AS level, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_brand")
def level_dictionary(spark, sf):
    return trees.level_dictionary(T.table(spark, sf, "part"), "p_brand", "p_partkey")


@_query("SELECT DISTINCT s_suppkey AS person, o_custkey AS parent FROM supplier JOIN orders ON o_orderkey = s_suppkey")
def pedigree_parents(spark, sf):
    people = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"))
    return graphs.parents(people, T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent")))


@_query("SELECT DISTINCT s_suppkey AS person, o_orderkey AS child FROM supplier JOIN orders ON o_custkey = s_suppkey")
def pedigree_children(spark, sf):
    people = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"))
    return graphs.children(people, T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent")))


@_query("SELECT p_partkey AS profile_id, p_size AS locus, CAST(i - 1 AS INT) AS allele_idx, w[i] AS allele FROM (SELECT p_partkey, p_size, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, p_size, string_split(p_type, ' ') AS w FROM part))")
def profile_explode(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("profile_id"), F.col("p_size").alias("locus"), F.split("p_type", " ").alias("alleles"))
    return graphs.explode_profiles(p)
