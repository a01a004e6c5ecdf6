"""Secret scan with corpus-wide ownership frequency.

Patterns give candidate spans; the hash of each candidate value is aggregated
over the corpus by distinct repositories and owners. A value that many owners
have is a copied example, one that belongs to a single owner and looks random
is live; the live values are then also found where they stand without their keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

# The patterns of the base kinds, in the order of their names
_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = f"({_WORD}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "reuse")
#: a run that may hold known values without their keyword; it must also hold a digit
REUSE = "(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}"
_PART = "[A-Za-z0-9]+"
#: distinct owners from which a value is a copied example
EXAMPLE_OWNERS = 3
PLACEHOLDER = "(?i)example|sample|dummy|test|changeme|xxxx|0000|1234"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int, pattern: str, least: int, group: int = 0, holds: str = "") -> Column:
    """The matches of ``pattern`` whose ``group`` has ``least`` characters and ``holds``: start, kind, end, value.

    The text between matches and the matches alternate, so their lengths add up
    to the places, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("m")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        end = start + F.length(x["m"])
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when((F.length(value) >= least) & value.rlike(holds), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")), add, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def looks_live(value: Column) -> Column:
    """Mixed, varied characters and no word of a placeholder."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 6
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def _copies(runs: DataFrame, live: DataFrame) -> DataFrame:
    """The places of live values within runs, alone or beside other characters; a value does not begin or end within a word.

    Runs meet values by the value's longest alphanumeric part (the first of equals), so a run proposes each of its parts once.
    """
    parts = lambda c: _spans(F.col(c), 3, _PART, 1)
    longest = F.array_max(F.transform(parts("value"), lambda p: F.struct(F.length(p["value"]).alias("n"), (-p["start"]).alias("at"), p["value"].alias("part"))))
    keyed = live.withColumn("k", longest).select("value", "owners", "repos", "verdict", (-F.col("k.at")).alias("skip"), F.sha2("k.part", 256).alias("part"))
    found = runs.select("rid", F.col("start").alias("run"), F.explode(parts("value")).alias("p")).select("rid", "run", F.col("p.start").alias("at"), F.sha2("p.value", 256).alias("part"))
    found = found.join(keyed, "part").drop("part").join(runs.select("rid", F.col("start").alias("run"), F.col("value").alias("whole")), ["rid", "run"])
    first, size = F.col("at") - F.col("skip"), F.length("value")
    same = (first >= 0) & (F.substring("whole", first + 1, size) == F.col("value"))
    inside = lambda a, b: F.concat(F.substring("whole", a, F.lit(1)), F.substring("value", b, F.lit(1))).rlike("^[A-Za-z0-9]{2}$")
    found = found.filter(same & ~((first > 0) & inside(first, F.lit(1))) & ~inside(first + size + 1, F.lit(-1)))
    start = F.col("run") + first
    return found.select("rid", start.alias("start"), F.lit(3).alias("kind"), (start + size).alias("end"), "value", "owners", "repos", "verdict").distinct()


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(id, spans) for each row: spans is an array of (start, kind, end, value, owners,
    repos, verdict), ascending by start and then kind.

    Kinds are numbered as in ``KINDS``. ``repo_col`` defaults to the id, a
    repository of one document. Verdicts: ``example`` (EXAMPLE_OWNERS owners or
    more have the value), ``live`` (one owner or none named, and it looks live), else
    ``unclear``. Null and empty texts have no spans; a null owner or repository
    counts as none; repeated rows each get their row, and count once as owner and
    repository. Other columns are ignored; an empty table gives no rows.
    """
    work = Work(docs.sparkSession, "secret-scan")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col or id_col).alias("repo"), F.col(owner_col).alias("owner"), text.alias("text"))
    base = F.concat(_spans(F.col("text"), 0, ASSIGN, 8, 2), _spans(F.col("text"), 1, ACCESS, 16), _spans(F.col("text"), 2, HEX, 32))
    rows = rows.select("doc_id", "repo", "owner", base.alias("base"), _spans(F.col("text"), 3, REUSE, 8, holds="[0-9]").alias("bare"))
    # a run inside a base span has no place of its own
    rows = rows.withColumn("bare", F.filter("bare", lambda x: ~F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))))
    rows = work.cut(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")

    one = lambda name: rows.filter(F.size(name) > 0).select("rid", "repo", "owner", F.explode(name).alias("s")).select("rid", "repo", "owner", "s.*", F.sha2("s.value", 256).alias("hash"))
    base, bare = one("base"), one("bare")
    owned = base.groupBy("hash", "owner", "repo").agg(F.max(looks_live(F.col("value"))).alias("live"))
    stats = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.max("live").alias("live"))
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") <= 1) & F.col("live"), "live").otherwise("unclear")
    stats = work.cut(stats.select("hash", "owners", "repos", verdict.alias("verdict")), "owners")
    span = F.struct("start", "kind", "end", "value", "owners", "repos", "verdict")
    live = base.join(stats.filter("verdict = 'live'"), "hash").select("value", "owners", "repos", "verdict").distinct()
    all_spans = base.join(stats, "hash").select("rid", span.alias("s")).unionByName(_copies(bare, live).select("rid", span.alias("s")))
    by_row = all_spans.groupBy("rid").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    # what overlaps a base span is not a place of its own
    own = lambda x: (x["kind"] < 3) | ~F.exists("spans", lambda y: (y["kind"] < 3) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    by_row = by_row.withColumn("spans", F.filter("spans", own))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint,verdict:string>>")
    return rows.select("rid", "doc_id").join(by_row, "rid", "left").select(F.col("doc_id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
