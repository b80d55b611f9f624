"""Secret scans over versioned files, each content scanned once per rule version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``words``: some of them, in lower case, is in every text with a match; ``run``: so many characters of this class follow
    each other in it. Both are plain tests that spare most texts the pattern.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    words: tuple[str, ...] = ()
    run: str = ""


# access and hex: a run is one class, so a match that is too short hides none that is long enough
RULES = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", 1, r"(AKIA[A-Z0-9]{16,})", 1, 20, ("akia",)),
    Rule("hex", 1, r"([0-9a-f]{24,})", 1, 24, (), "0123456789abcdef"),
)


def _may_match(text: Column, rule: Rule) -> Column:
    test = F.lit(True)
    if rule.words:
        low = F.lower(text)
        test = sum((low.contains(w).cast("int") for w in rule.words), F.lit(0)) > 0
    if rule.run:
        test = test & F.translate(text, rule.run, rule.run[0] * len(rule.run)).contains(rule.run[0] * rule.least)
    return test


def _spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the rule's matches that are long enough."""
    # one pass yields the gap before each match, another the match, a third the measured part
    # (the end matches too: without it each place after the last match would be tried as a gap's beginning)
    gap = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)(?:{rule.pattern}|\z)"), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # positions are summed up in slices of about the root of their number, as an array grows by copying
    matches = F.arrays_zip(gap.alias("gap"), whole.alias("whole"), part.alias("part"))
    width = F.ceil(F.sqrt(F.greatest(F.size(matches), F.lit(1)))).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(matches), F.lit(1)) - 1) / width).cast("int")), lambda i: F.slice(matches, i * width + 1, width))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("found"))

    def step(acc, x):
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["whole"]), F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(F.char_length(x["part"]) >= rule.least, F.lit(False)), F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    def join(acc, x):
        moved = F.transform(x["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["found"], moved).alias("found"))

    return F.aggregate(F.transform(slices, lambda s: F.aggregate(s, zero, step)), zero, join, lambda acc: acc["found"])


def scan_versions(versions: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings per path, new ledger rows) for every version of every file in ``versions``.

    The project keeps no versioned texts of its own (configurations and exports are files), so the operator is general:
    ``path`` names a file, and any number of rows may be its historical versions. A blob is a content, addressed by its
    SHA-256; null counts as the empty text. Only (blob, rule, rule version) triples that ``ledger`` lacks are scanned, each
    once however many paths hold the blob: the text is read where the smallest path of the blob stands. Ledger rows:
    blob_id, kind, rule_version, spans (array of start and end in code points); a scanned blob without findings has a row
    with no spans. Findings: path, blob_id and one span array per kind; equal rows of a path appear as often as they occur.
    An empty table gives no rows. Only Spark's own functions are used.
    """
    held = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob_id", F.unhex(F.sha2("text", 256)))
    entries = held.select("path", "blob_id")
    firsts = entries.groupBy("blob_id").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        due = firsts.withColumn("due", wanted.getField("kind"))
    else:
        pairs = firsts.select("blob_id", "path", F.explode(wanted).alias("w")).select("blob_id", "path", "w.kind", "w.rule_version")
        fresh = pairs.join(ledger.select("blob_id", "kind", "rule_version"), ["blob_id", "kind", "rule_version"], "left_anti")
        due = fresh.groupBy("blob_id", "path").agg(F.collect_list("kind").alias("due"))
    # path and content together: a blob with very many paths is not gathered in one task
    bodies = held.join(due.select(F.col("blob_id").alias("_blob"), F.col("path").alias("_path"), "due"), (F.col("blob_id") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path"))).select("blob_id", "text", "due")
    empty = F.array().cast("array<struct<start:long,end:long>>")
    # plain tests first; only texts that pass one are shown to the patterns
    tests = F.struct(*[(F.array_contains("due", r.kind) & _may_match(F.col("text"), r)).alias(r.kind) for r in rules])
    tested = bodies.withColumn("test", tests)
    some = " or ".join(f"test.{r.kind}" for r in rules)
    found = [F.when(F.col(f"test.{r.kind}"), _spans(F.col("text"), r)).otherwise(empty).alias(r.kind) for r in rules]
    # equal rows of one path come out twice here, slim by now
    matched = tested.where(some).select("blob_id", *found).groupBy("blob_id").agg(*[F.first(r.kind).alias(r.kind) for r in rules])
    scanned = due.select("blob_id", "due").join(matched, "blob_id", "left")
    entries_of = [F.when(F.array_contains("due", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.coalesce(r.kind, empty).alias("spans"))) for r in rules]
    scanned = scanned.select("blob_id", F.filter(F.array(*entries_of), lambda x: x.isNotNull()).alias("f"))
    new = scanned.select("blob_id", F.explode("f").alias("x")).select("blob_id", "x.kind", "x.rule_version", "x.spans")
    known = new if ledger is None else new.unionByName(ledger.join(F.broadcast(versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")), ["kind", "rule_version"]).select(*new.columns))
    per = known.groupBy("blob_id").agg(*[F.first(F.when(F.col("kind") == r.kind, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules])
    hits = per.where(" or ".join(f"size({r.kind}) > 0" for r in rules))
    back = entries.join(hits, "blob_id", "left").select("path", "blob_id", *[F.coalesce(r.kind, empty).alias(r.kind) for r in rules])
    return back, new
