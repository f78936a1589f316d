"""Secret scans over a ledger of blobs: every version is addressed by its content, and only unseen pairs of blob and rule
version are scanned. DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratersight.llm import scratch


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: matched leftmost, without overlap. group, least: matches whose group is shorter go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The first three are the base rules; a longer minimum inside a pattern stands for dropping shorter runs.
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = 3


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names a set of rules in the ledger: other rules, or another order, have another name."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:24]


_SEEN = "blob string, rules string"
_FOUND = "blob string, rules string, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; an empty one if it is not there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _any(rules: tuple[Rule, ...]) -> str:
    return "|".join(f"(?:{r.pattern})" for r in rules)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs (blob, text) that hold a match; spans are sorted, in code points, end exclusive. Repeated
    blobs count once.

    Spark gives matches without their places, so these come from the pieces between: a match starts after all pieces and
    matches before it, a running sum over the match's number."""
    hits = blobs.dropDuplicates(["blob"])

    def lengths(rule: Rule):
        size = lambda x: F.transform(x, F.length)
        match = size(F.expr(f"regexp_extract_all(text, {_literal(rule.pattern)}, 0)"))
        own = match if rule.group == 0 else size(F.expr(f"regexp_extract_all(text, {_literal(rule.pattern)}, {rule.group})"))
        return F.arrays_zip(size(F.split("text", rule.pattern, -1)).alias("gap"), match.alias("size"), own.alias("own"))

    kinds = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), lengths(r).alias("parts")) for i, r in enumerate(rules)))
    each = hits.select("blob", F.explode(kinds).alias("k")).select("blob", "k.rank", "k.kind", "k.least", F.posexplode("k.parts").alias("no", "part"))
    before = Window.partitionBy("blob", "rank").orderBy("no")
    placed = each.withColumn("end", F.sum(F.col("part.gap") + F.coalesce("part.size", F.lit(0))).over(before)).filter("part.size is not null and part.own >= least")
    span = F.struct((F.col("end") - F.col("part.size")).alias("start"), "rank", "kind", "end")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'" if "\"" not in pattern else 'r"' + pattern.replace('"', "\\x22") + '"'


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, under these very rules, of versions (doc_id, text), add it to the ledger, and give
    every path its findings.

    Returns doc_id, blob (SHA-256 of the text) and spans for each row. Null texts count as empty. Rows of equal texts,
    however many, are one blob, which is scanned once. Findings are written before the blobs are marked as seen, so a run
    that broke off is repeated without loss, and findings written twice count once. Other columns are ignored."""
    spark, version = versions.sparkSession, version_of(rules)
    versions = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    addressed = versions.withColumn("blob", F.sha2("text", 256))
    paths = scratch.table(addressed.select("doc_id", "blob"), "paths")
    seen = _ledger(spark, f"{ledger}/seen", _SEEN).filter(F.col("rules") == version)
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti")
    unseen = scratch.table(unseen.withColumn("wanted", F.lit(True)), "unseen").withColumnsRenamed({"blob": "_blob", "doc_id": "_doc"})
    texts = addressed.join(unseen, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    # a filter of both sides: the optimizer can't search texts before the join has left those of unseen blobs
    texts = texts.filter(F.when(F.col("wanted"), F.col("text").rlike(_any(rules))))
    find(texts.select("blob", "text"), rules).select("blob", F.lit(version).alias("rules"), "spans").write.mode("append").parquet(f"{ledger}/findings")
    unseen.select(F.col("_blob").alias("blob"), F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/seen")
    found = _ledger(spark, f"{ledger}/findings", _FOUND).filter(F.col("rules") == version).groupBy("blob").agg(F.first("spans").alias("spans"))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text, from scan()'s rows."""
    base = F.filter("spans", lambda s: s["rank"] < BASE)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in RULES[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def oracle_sql() -> str:
    """DuckDB's way to digest(scan()) of `documents`."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds = " union all ".join(
        f"select r, {i} as rank, {quoted(k.kind)} as kind, {k.least} as least, list_transform(string_split_regex(text, {quoted(k.pattern)}), lambda x: length(x)) as gap, "
        f"list_transform(regexp_extract_all(text, {quoted(k.pattern)}, 0), lambda x: length(x)) as size, list_transform(regexp_extract_all(text, {quoted(k.pattern)}, {k.group}), lambda x: length(x)) as own from t"
        for i, k in enumerate(RULES)
    )
    text = "coalesce(string_agg(kind || ':' || cast(s as varchar) || ':' || cast(s + n as varchar), ',' order by s, rank){}, '')"
    counts = ", ".join(f"cast(count(*) filter (where kind = {quoted(k.kind)}) as bigint) as n_{k.kind}" for k in RULES[:BASE])
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as ({kinds}),
e as (select r, rank, kind, least, unnest(range(1, len(size) + 1)) as i, gap, size, own from m),
p as (select r, rank, kind, cast(list_sum(gap[1:i]) + coalesce(list_sum(size[1:i-1]), 0) as bigint) as s, size[i] as n from e where own[i] >= least)
select doc_id, {counts}, sha256({text.format(f" filter (where rank < {BASE})")}) as base_sha256, {text.format(" filter (where rank is not null)")} as spans
from t left join p using (r) group by t.r, doc_id"""
