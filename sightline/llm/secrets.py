"""Secret scans over an incremental ledger of blobs; DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a folder of
Parquet: one row per blob and scan, with the versions of the rules that were run and the spans
they found. ``scan`` runs each rule on those blobs only for which the ledger does not hold that
rule at that version, on one copy of the blob, appends what it finds, and joins findings back
to every path that holds the blob. A rule's version is a hash of its definition, so an altered
rule is new and the others are not run again.

Spans count code points, the end exclusive. They come from cutting a text at a pattern's
matches: the lengths of cuts and matches, summed, are the positions.

Edge cases: a null text is an empty one. Copies are scanned once. Rows with the same path and
text count once per row in the result. A rule list without new rules scans nothing. A lost
executor costs a re-run of its tasks; a scan that fails leaves no committed part in the ledger,
and its blobs are scanned next time. Columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import sha256_hex

# Patterns of the contract.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A private key with its body: to the END line where no other such line lies between, else over
# the header and base64 lines that follow. Java and RE2 read it alike; groups are bounded, since
# Java's matcher recurses on them.
_B64 = "[A-Za-z0-9+/=]"
_GAP = "[ \\t\\r\\n\\\\>#*|\"',]"
_END_OF_LINE = "(?:\\r?\\n|[\\\\\"'])"
PEM = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    "(?:[^-]*(?:-{1,4}[^-]+){0,100}-----END [A-Z ]*PRIVATE KEY-----"
    f"|(?:(?:{_GAP}+[A-Za-z-]+:\\x20[^\r\n\\\\]*){{0,8}}(?:{_GAP}+{_B64 * 16}{_B64}*){{1,500}}(?:{_GAP}+[A-Za-z0-9+/]+=+)?)?"
    f"(?:{_END_OF_LINE}[ \\t>#*|]*[A-Za-z0-9+/]{{1,15}}(?:{_END_OF_LINE}|\\z))?)"
)


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of group ``group``; ``hint`` stands in every match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def version(self) -> str:
        text = "\n".join((self.kind, self.pattern, str(self.group), str(self.least)))
        return f"{self.kind}@{hashlib.sha256(text.encode()).hexdigest()[:16]}"


BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("pem", PEM, 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
)

SPANS = "array<struct<kind:string,start:int,stop:int>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def spans_of(text: Column, rule: Rule) -> Column:
    """All matches of a rule in ``text`` as structs of kind, start and stop."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    empty = no_spans()
    begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(a: Column, pair: Column) -> Column:
        start = a["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], rule.pattern, rule.group)
        one = F.array(
            F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), stop.alias("stop"))
        )
        enough = F.length(value) >= rule.least
        return F.struct(
            stop.alias("at"),
            F.when(enough, F.concat(a["found"], one)).otherwise(a["found"]).alias("found"),
        )

    pairs = F.filter(
        F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))),
        lambda p: p["hit"].isNotNull(),
    )
    found = F.aggregate(pairs, begin, step)["found"]
    if rule.hint:
        return F.when(text.contains(rule.hint), found).otherwise(empty)
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(empty)


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(folder)


def open_ledger(spark: SparkSession, folder: str) -> None:
    """Makes an empty ledger if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{folder}/blobs")


def scan(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id"
) -> DataFrame:
    """(path, blob, spans) for every row of ``versions``; the ledger in ``folder`` is extended."""
    paths, found = findings(versions, folder, rules, path)
    return paths.join(found, "blob", "left").select(
        F.col("path").alias(path), "blob", F.coalesce("spans", no_spans()).alias("spans")
    )


def findings(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """(path, blob) of every row, and (blob, spans) of the blobs in the ledger with spans."""
    spark = versions.sparkSession
    open_ledger(spark, folder)
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select(F.col(path).alias("path"), text.alias("text")).withColumn(
        "blob", sha256_hex(F.col("text"))
    )
    batch = f"{folder}/paths/{uuid.uuid4().hex}"
    addressed.select("path", "blob").write.parquet(batch)
    paths = spark.read.parquet(batch)
    wanted = [r.version for r in rules]
    seen = (
        ledger_rows(spark, f"{folder}/blobs")
        .select("blob", F.explode("rules").alias("rule"))
        .where(F.col("rule").isin(wanted))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("seen"))
    )
    every = F.array(*[F.lit(v) for v in wanted]) if wanted else F.array().cast("array<string>")
    unseen = (
        paths.groupBy("blob")
        .agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("first"))
        .join(seen, "blob", "left")
        .select(
            F.col("blob").alias("of"),
            F.col("first.path").alias("at"),
            F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen")).alias("todo"),
        )
        .where(F.size("todo") > 0)
    )
    # one copy of each unseen blob; dealt out by path and blob, so that no blob's copies meet
    texts = addressed.join(
        unseen.hint("shuffle_hash"),
        F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("of")),
    )
    found = [
        F.when(F.array_contains("todo", r.version), spans_of(F.col("text"), r)).otherwise(
            no_spans()
        )
        for r in rules
    ]
    if found:
        texts.select(
            "blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans")
        ).dropDuplicates(["blob"]).write.mode("append").parquet(f"{folder}/blobs")
    kinds = [r.kind for r in rules]
    valid = (
        ledger_rows(spark, f"{folder}/blobs")
        .where(F.size("spans") > 0)
        .select("blob", F.explode("rules").alias("rule"), "spans")
        .where(F.col("rule").isin(wanted))
        .select(
            "blob",
            F.filter("spans", lambda s: s["kind"] == F.substring_index("rule", "@", 1)).alias("spans"),
        )
        .where(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    ordered = F.transform(
        F.array_sort(
            F.transform(
                "spans",
                lambda s: F.struct(
                    s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")
                ),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    return paths, valid.select("blob", ordered.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        path,
        *[kind(r.kind).alias(f"n_{r.kind}") for r in BASE],
        sha256_hex(listed(base)).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], before, F.lit(mark)))
            .otherwise(a["out"])
            .alias("out"),
        )

    done = F.aggregate(spans, begin, step)
    tail = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], tail))


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    per_rule = "\n  UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, {r.group} AS grp, "
        f"regexp_extract_all(t, '{quoted(r.pattern)}') AS hits, "
        f"regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS vals, "
        f"string_split_regex(t, '{quoted(r.pattern)}') AS gaps FROM d"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({per_rule}),
one AS (SELECT doc_id, kind, rank, hits[i] AS hit, vals[i] AS val, least,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
  FROM cut, unnest(range(1, len(hits) + 1)) AS u(i)),
span AS (SELECT doc_id, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e
  FROM one WHERE length(val) >= least),
said AS (SELECT *, kind || ':' || s || ':' || e AS w FROM span),
doc AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(w, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
  string_agg(w, ',' ORDER BY s, rank) AS spans FROM said GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN doc USING (doc_id)
"""


ORACLE = _oracle()
