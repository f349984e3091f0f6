"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256.  A ledger holds which (blob, rule, rule version) were scanned;
only pairs that it lacks are scanned, each blob once however many paths hold it, and findings are joined back to all paths.
Only DataFrame functions are used: a rule's matches come from ``regexp_extract_all`` and the text between them from ``split``,
so offsets are running sums of lengths in code points.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import settle


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost, without overlap; matches whose ``group`` has under ``least`` code points are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
LEDGER_SCHEMA = "blob_id string, kind string, version int"
FINDINGS_SCHEMA = "blob_id string, kind string, version int, start long, end long"


def _array_of(rules, what) -> Column:
    return F.array(*[what(r) for r in rules])


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob_id, kind, version, start, end) of all matches; ``blobs``: blob_id, text, kinds (which rules to apply)."""

    def pieces(r: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        judged = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        gaps = F.slice(F.split("text", r.pattern, -1), 1, F.size(found))
        both = F.arrays_zip(gaps.alias("gap"), found.alias("found"), judged.alias("judged"))
        lengths = F.transform(both, lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["found"]).cast("long").alias("n"), (F.length(x["judged"]) >= r.least).alias("good")))
        wanted = F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern)
        return F.when(wanted, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), lengths.alias("pieces")))

    each = blobs.select("blob_id", F.explode(_array_of(rules, pieces)).alias("x")).where("x is not null")
    each = each.select("blob_id", "x.kind", "x.version", F.posexplode("x.pieces").alias("i", "p")).dropDuplicates(["blob_id", "kind", "i"])  # a blob may come twice
    upto = F.sum(F.col("p.gap") + F.col("p.n")).over(Window.partitionBy("blob_id", "kind").orderBy("i"))
    return each.withColumn("end", upto).where("p.good").select("blob_id", "kind", "version", (F.col("end") - F.col("p.n")).alias("start"), "end")


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brings ledger and findings up to date with ``versions`` (path, text); returns (paths, ledger, findings).

    ``path`` is of any type that has an order and can be written as a string.  paths: (path, blob_id) of each row; ledger and findings: what was handed in with what is new added.  A null text is the
    empty blob; a null path is a path; rows that repeat are scanned once.  Equal blobs are scanned once, ever, for each rule version.
    """
    spark = versions.sparkSession
    ledger = spark.createDataFrame([], LEDGER_SCHEMA) if ledger is None else ledger.select("blob_id", "kind", "version")
    findings = spark.createDataFrame([], FINDINGS_SCHEMA) if findings is None else findings
    versions = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob_id", F.sha2("text", 256))
    paths = settle(versions.select("path", "blob_id"), "paths")
    picked = F.coalesce(F.concat(F.lit("p"), F.col("path").cast("string")), F.lit("n")).alias("picked")  # one path of a blob tells the text
    blobs = paths.groupBy("blob_id").agg(F.min(picked).alias("picked"))
    rule_rows = _array_of(rules, lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
    unseen = blobs.select("blob_id", "picked", F.explode(rule_rows).alias("rule")).select("blob_id", "picked", "rule.*").join(ledger, ["blob_id", "kind", "version"], "left_anti")
    pending = settle(unseen.groupBy("blob_id", "picked").agg(F.collect_set("kind").alias("kinds")), "pending")
    texts = versions.select("blob_id", picked, "text").join(pending.hint("shuffle_hash"), ["blob_id", "picked"])
    new = scan(texts, rules)
    new = settle(new.groupBy("blob_id", "kind", "version", "start").agg(F.max("end").alias("end")), "findings")
    scanned = pending.select("blob_id", F.explode("kinds").alias("kind")).join(spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int"), "kind").select("blob_id", "kind", "version")
    return paths, ledger.unionByName(scanned), findings.unionByName(new.select("blob_id", "kind", "version", "start", "end"))


def path_findings(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, blob_id, kind, version, start, end): findings joined back to every path that has the blob, repeated rows once."""
    return paths.distinct().join(findings, "blob_id").select("path", "blob_id", "kind", "version", "start", "end")


def spans_by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob_id, spans): sorted array of (start, rank of the kind, kind, end) with the rules' current versions."""
    rank = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    return findings.where(rank.isNotNull()).groupBy("blob_id").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def secret_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``: doc_id, text.

    ``spans``: kind:start:end of all kinds by start, then kind as the rules stand, comma-joined, code points, end exclusive;
    ``base_sha256``: the hash of those of the base kinds.  A text without findings, null or empty has "" there.
    """
    paths, _, findings = scan_history(docs.select(F.col("doc_id").cast("long").alias("path"), F.col("text").cast("string").alias("text")), rules=rules)
    base = [r.kind for r in BASE_RULES]
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    rows = paths.join(settle(spans_by_blob(findings, rules), "spans"), "blob_id", "left").withColumn("spans", F.coalesce("spans", none))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"))


def disjoint_spans(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob_id, starts, ends): sorted arrays of the spans that the rules' current findings cover, overlapping ones as one."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    by = Window.partitionBy("blob_id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = findings.where(current).withColumn("apart", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int"))
    rows = rows.withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("blob_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    return runs.select("blob_id", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"))


#: Code points of the blocks that a text is cut into before its spans are taken out, so that no step counts from the text's start.
BLOCK = 1024


def without_spans(text: Column, starts: Column, ends: Column, mark: str) -> Column:
    """``text`` with each of the sorted, disjoint spans replaced by ``mark``; linear in the text and in the spans."""
    blocks = F.col("text_blocks")
    block = lambda at: F.element_at(blocks, (at / BLOCK).cast("int") + 1)
    within = lambda at: F.pmod(at, F.lit(BLOCK)).cast("int")

    def cut(x):
        a, b = x["a"], x["b"]
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        same = F.substring(block(a), within(a) + 1, (b - a).cast("int"))
        over = F.concat(F.substring(block(a), within(a) + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(block(b - 1), F.lit(1), within(b - 1) + 1))
        return F.when(b <= a, "").when(first == last, same).otherwise(over)

    zero, end = F.array(F.lit(0).cast("long")), F.array(F.length(text).cast("long"))
    gaps = F.arrays_zip(F.concat(zero, ends).alias("a"), F.concat(starts, end).alias("b"))
    return F.array_join(F.transform(gaps, cut), mark)


def redacted(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark`` and ``n_chars`` set anew; other columns and texts stay as they are.

    Overlapping findings are replaced as one.  The key word before an assigned secret goes with it.
    """
    columns = docs.columns
    _, _, findings = scan_history(docs.select(F.col("doc_id").cast("long").alias("path"), "text"), rules=rules)
    spans = settle(disjoint_spans(findings, rules), "spans")
    whole = F.struct(*[F.col(c) for c in columns]).alias("row")
    rows = docs.select(whole, F.col("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_id")).join(spans.hint("shuffle_hash"), "blob_id", "left")
    found = F.col("starts").isNotNull()
    rows = rows.withColumn("text_blocks", F.when(found, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    rows = rows.withColumn("clean", F.when(found, without_spans(F.col("text"), F.col("starts"), F.col("ends"), mark)))
    new = {"text": F.coalesce("clean", "row.text"), "n_chars": F.when(found, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns])


#: The rules of a second scan: one of the base rules was made stricter since the first.
RAISED_RULES = (*BASE_RULES[:2], replace(BASE_RULES[2], version=2, least=40))


def history_report(docs: DataFrame) -> DataFrame:
    """(path, kind, version, n): findings in every path of a two-step history; where path is null, pairs in the ledger.

    First all texts of ``docs`` (doc_id, text) are scanned as ``v1/<doc_id>`` by the base rules, then as ``v2/<doc_id>``, with one word
    rewritten, by RAISED_RULES.  A text without that word is one blob in both, so only the raised rule sees it again.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    version = lambda n, text: docs.select(F.concat(F.lit(f"v{n}/"), "doc_id").alias("path"), text.alias("text"))
    before, ledger, findings = scan_history(version(1, F.col("text")), rules=BASE_RULES)
    after, ledger, findings = scan_history(version(2, F.replace("text", F.lit("secret"), F.lit("SECRET"))), ledger, findings, RAISED_RULES)
    found = path_findings(before.union(after), findings).groupBy("path", "kind", "version").agg(F.count("*").alias("n"))
    return found.unionByName(ledger.groupBy(F.lit(None).cast("string").alias("path"), "kind", "version").agg(F.count("*").alias("n")))


def history_sql() -> str:
    """DuckDB SQL for the rows of ``history_report``."""
    scans = []
    for texts, rules in (("t1", BASE_RULES), ("t2", RAISED_RULES)):
        for r in rules:
            pattern = "'" + r.pattern.replace("'", "''") + "'"
            scans.append(f"SELECT {texts} AS t, '{r.kind}' AS kind, {r.version} AS version, len([x for x in regexp_extract_all({texts}, {pattern}, {r.group}) if length(x) >= {r.least}]) AS n FROM d")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t1, replace(coalesce(text, ''), 'secret', 'SECRET') AS t2 FROM documents),
s AS ({" UNION ".join(scans)}),
p AS (SELECT DISTINCT 'v1/' || doc_id AS path, t1 AS t FROM d UNION SELECT 'v2/' || doc_id, t2 FROM d)
SELECT path, kind, version, CAST(sum(n) AS BIGINT) AS n FROM p JOIN s USING (t) WHERE n > 0 GROUP BY 1, 2, 3
UNION ALL SELECT NULL, kind, version, count(*) FROM s GROUP BY 2, 3"""


def oracle_sql(rules=RULES) -> str:
    """DuckDB SQL for the rows of ``secret_report``."""
    kinds = []
    for rank, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        kinds.append(f"""
SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, i, length(gaps[i]) AS gap, length(found[i]) AS n, length(judged[i]) >= {r.least} AS good
FROM (SELECT *, unnest(generate_series(1, len(found))) AS i
      FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS found, regexp_extract_all(text, {p}, {r.group}) AS judged
            FROM documents WHERE regexp_matches(text, {p})))""")
    span = "kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, rank"
    return f"""
WITH pieces AS ({" UNION ALL ".join(kinds)}),
spans AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM pieces),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg({span}) FILTER (rank < {len(BASE_RULES)}) AS base, string_agg({span}) AS spans
           FROM spans WHERE good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""
