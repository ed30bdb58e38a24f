"""Queries over documents, labels and conversations: metrics, samples, text, tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.text import unseen_numbers as unseen
from sightline.operators import cases as Z
from sightline.operators import evaluate as E
from sightline.operators import quantiles as QT
from sightline.operators import sampling as U
from sightline.operators.ordered import neighbours, tick_chunk
from sightline.plans import adapters as A
from sightline.plans.registry import query

_SCORED = """scored AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS score, n_chars,
    quality = 1 AS y, toxic = 1 AS flag FROM documents JOIN labels USING (doc_id))"""


def scored(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(A.table(spark, d, "labels"), "doc_id").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("n_chars").cast("double").alias("score"),
        (F.col("quality") == 1).alias("y"),
        (F.col("toxic") == 1).alias("flag"),
    )


def _hist(spark, d, keys=()):
    return E.score_histogram(scored(spark, d), F.col("score"), F.col("y"), keys)


_RANKED = f"""WITH {_SCORED},
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score)
    + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM scored)"""


@query(
    "lang:s positives:l negatives:l auc:d",
    f"""{_RANKED}
SELECT lang, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
  (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0)
  / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0) AS auc FROM r GROUP BY 1""",
)
def roc_auc(spark, d):
    return E.roc_auc(_hist(spark, d, ["lang"]), ["lang"])


_CUTS = f"""WITH {_SCORED},
h AS (SELECT score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM h WINDOW w AS (ORDER BY score DESC))"""


@query("pr_auc:d", f"{_CUTS} SELECT sum(pos * tp / (tp + fp)) / max(p) AS pr_auc FROM c")
def pr_auc(spark, d):
    return E.pr_auc(_hist(spark, d))


@query(
    "tpr_at_1pct:d tpr_at_10pct:d",
    f"""{_CUTS} SELECT coalesce(max(tp / p) FILTER (fp / n <= 0.01), 0) AS tpr_at_1pct,
  coalesce(max(tp / p) FILTER (fp / n <= 0.1), 0) AS tpr_at_10pct FROM c""",
)
def tpr_at_fpr(spark, d):
    return E.tpr_at_fpr(_hist(spark, d), (0.01, 0.1))


@query(
    "brier:d",
    f"WITH {_SCORED} SELECT avg(power(score / (score + 1000) - y::INT, 2)) AS brier FROM scored",
)
def brier(spark, d):
    p = F.col("score") / (F.col("score") + 1000)
    return E.brier(scored(spark, d), p, F.col("y"))


_TABLES_SQL = "[" + ", ".join(str(table) for table in E.poisson_tables()) + "]"


@query(
    "n:l low:d median:d high:d",
    f"""WITH {_SCORED},
bins AS (SELECT row_number() OVER (ORDER BY score) AS place, pos, neg FROM (
    SELECT score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM scored GROUP BY 1)),
counted AS (SELECT place, 1 AS label, pos AS n FROM bins UNION ALL SELECT place, 0, neg FROM bins),
parts AS (SELECT place, label, p AS power, CASE WHEN p < {E.POWERS} THEN n & (1::BIGINT << p) ELSE (n >> p) << p END AS rows_of
  FROM counted CROSS JOIN (SELECT unnest(range({E.POWERS} + 1)) AS p)),
t AS (SELECT *, md5(place || '/' || label || '/' || power || '/' || r || '/0') AS d
  FROM parts CROSS JOIN (SELECT unnest(range(1, 101)) AS r) WHERE rows_of > 0),
u AS (SELECT *, ('0x' || substr(d, 1, 8))::UBIGINT / 4294967296.0 AS u, ('0x' || substr(d, 9, 8))::UBIGINT / 4294967296.0 AS v FROM t),
w AS (SELECT r, place, label = 1 AS y, CASE WHEN power < {E.POWERS} THEN len(list_filter({_TABLES_SQL}[power + 1], lambda x: x <= u))
    ELSE greatest(round(rows_of + sqrt(rows_of) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)), 0) END AS w FROM u),
h AS (SELECT r, place AS score, coalesce(sum(w) FILTER (y), 0) AS pos, coalesce(sum(w) FILTER (NOT y), 0) AS neg FROM w WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY r ORDER BY score) - neg AS below, sum(pos) OVER (PARTITION BY r) AS p,
    sum(neg) OVER (PARTITION BY r) AS n FROM h),
a AS (SELECT r, sum(pos * (below + neg / 2.0)) / (max(p) * max(n)) AS auc FROM c GROUP BY 1 HAVING max(p) * max(n) > 0)
SELECT count(*) AS n, quantile_cont(auc, 0.05) AS low, quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.95) AS high FROM a""",
)
def bootstrap_auc(spark, d):
    return E.bootstrap_auc(scored(spark, d), F.col("score"), F.col("y"), replicates=100)


@query(
    "r_yx:d slope:d intercept:d partial:d",
    f"""WITH {_SCORED},
v AS (SELECT score AS yy, CAST(y::INT AS DOUBLE) AS xx, CAST(doc_id % 97 AS DOUBLE) AS cc FROM scored),
f AS (SELECT regr_slope(yy, cc) AS sy, regr_intercept(yy, cc) AS iy, regr_slope(xx, cc) AS sx, regr_intercept(xx, cc) AS ix FROM v)
SELECT corr(yy, xx) AS r_yx, max(sy) AS slope, max(iy) AS intercept,
  corr(yy - (sy * cc + iy), xx - (sx * cc + ix)) AS partial FROM v, f""",
)
def partial_corr(spark, d):
    rows = scored(spark, d).select(
        F.col("score").alias("yy"),
        F.col("y").cast("int").cast("double").alias("xx"),
        (F.col("doc_id") % 97).cast("double").alias("cc"),
    )
    return E.partial_correlation("yy", "xx", "cc", rows)


@query(
    "lang:s n:l agree:d mean_gap:d",
    f"""WITH {_SCORED}
SELECT lang, count(*) AS n, avg((y = (n_chars > 500))::INT) AS agree,
  avg(abs(score / (score + 1000) - y::INT)) AS mean_gap FROM scored GROUP BY 1""",
)
def agreement(spark, d):
    rows = scored(spark, d).withColumn("guess", F.col("n_chars") > 500)
    gap = F.col("score") / (F.col("score") + 1000) - F.col("y").cast("int")
    return E.agreement(rows, "y", "guess", gap, ["lang"])


@query(
    "y:b flag:b n:l",
    f"WITH {_SCORED} SELECT y, flag, count(*) AS n FROM scored GROUP BY 1, 2",
)
def confusion(spark, d):
    return E.confusion(scored(spark, d), "y", "flag")


@query(
    "slice:s subgroup:s n:l positive:d longest:l",
    f"""WITH {_SCORED},
b AS (SELECT *, CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS size FROM scored)
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source'
    WHEN grouping(size) = 0 THEN 'size' ELSE 'all' END AS slice,
  CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source
    WHEN grouping(size) = 0 THEN size ELSE 'all' END AS subgroup,
  count(*) AS n, avg(y::INT) AS positive, max(n_chars) AS longest
FROM b GROUP BY GROUPING SETS ((), (lang), (source), (size))""",
)
def subgroup_slices(spark, d):
    size = (
        F.when(F.col("n_chars") <= 500, "short")
        .when(F.col("n_chars") <= 2000, "middle")
        .otherwise("long")
    )
    return E.subgroup_slices(
        scored(spark, d).withColumn("size", size),
        ["lang", "source", "size"],
        [
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("y").cast("int")).alias("positive"),
            F.max("n_chars").alias("longest"),
        ],
    )


@query(
    "doc_id:l lang:s",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang
  ORDER BY md5(doc_id || '/7'), doc_id) AS rn FROM documents) WHERE rn <= 20""",
)
def stratified_sample(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang")
    return U.stratified_sample(docs, ["lang"], "doc_id", 20, seed=7)


@query(
    "event_id:l user_id:l split:s",
    """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '/0'), user_id) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, user_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
FROM events JOIN u USING (user_id)""",
)
def group_split(spark, d):
    events = A.table(spark, d, "events").select("event_id", "user_id")
    return U.group_split(events, "user_id")


@query(
    "event_id:l split:s",
    """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '/0'), user_id) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, CASE WHEN rn <= n // 6 THEN 'val' ELSE 'train' END AS split
FROM events JOIN u USING (user_id)""",
)
def stopping_split(spark, d):
    events = A.table(spark, d, "events").select("event_id", "user_id")
    return U.stopping_split(events, "user_id").drop("user_id")


@query(
    "lang:s column:s n:l nulls:l mean:d std:d min:d max:d p50:d p99:d p999:d",
    """WITH t AS (SELECT lang, 'n_chars' AS "column", CAST(n_chars AS DOUBLE) AS v FROM documents
  UNION ALL SELECT lang, 'even_half', CASE WHEN doc_id % 2 = 0 THEN doc_id / 2.0 END FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, "column" ORDER BY v) - 1 AS i,
    count(v) OVER (PARTITION BY lang, "column") AS k FROM t WHERE v IS NOT NULL)
SELECT lang, "column", n, nulls, mean, std, min, max, p50, p99, p999 FROM
  (SELECT lang, "column", count(v) AS n, count(*) - count(v) AS nulls, avg(v) AS mean, stddev_samp(v) AS std,
     min(v) AS min, max(v) AS max FROM t GROUP BY 1, 2)
  JOIN (SELECT lang, "column", max(v) FILTER (i = round(0.5 * (k - 1))) AS p50,
     max(v) FILTER (i = round(0.99 * (k - 1))) AS p99,
     max(v) FILTER (i = round(0.999 * (k - 1))) AS p999 FROM r GROUP BY 1, 2) USING (lang, "column")""",
)
def distribution(spark, d):
    docs = A.table(spark, d, "documents").select(
        "lang",
        "n_chars",
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") / 2.0).alias("even_half"),
    )
    wanted = {"p50": 0.5, "p99": 0.99, "p999": 0.999}
    return QT.distribution(docs, ["lang"], ["n_chars", "even_half"], wanted)


@query(
    "session_id:l entity_id:l place:l alias:s",
    """WITH e AS (SELECT user_id // 10 AS session_id, user_id AS entity_id, count(*) FILTER (event_type = 'error') > 11 AS flagged,
    CASE WHEN user_id % 3 > 0 THEN CAST(count(*) AS DOUBLE) END AS score FROM events GROUP BY user_id)
SELECT session_id, entity_id, row_number() OVER (PARTITION BY session_id ORDER BY flagged DESC, score DESC NULLS LAST, CAST(entity_id AS VARCHAR)) AS place,
  'Player_' || (row_number() OVER (PARTITION BY session_id ORDER BY CAST(entity_id AS VARCHAR)) - 1) AS alias FROM e""",
)
def report_places(spark, d):
    events = A.table(spark, d, "events").groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "error") > 11).alias("flagged"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    entities = events.select(
        F.floor(F.col("user_id") / 10).cast("long").alias("session_id"),
        F.col("user_id").alias("entity_id"),
        "flagged",
        F.when(F.col("user_id") % 3 > 0, F.col("n")).alias("score"),
    )
    return Z.report_places(entities)


@query(
    "map:s entities:l flagged:l by_score:l ruled:l cheating:l unclear:l clean:l none:l held:l median:d p90:d",
    """WITH r AS (SELECT 'm' || (orders.o_orderkey % 5) AS map, o_orderkey AS entity, o_orderkey % 7 = 0 AS flagged, o_orderkey % 11 = 0 AS ruled,
    o_orderkey % 13 = 0 AS held, CASE WHEN o_custkey % 9 > 0 THEN (o_custkey % 100) / 100.0 ELSE 0 END AS pct,
    CASE o_orderkey % 4 WHEN 0 THEN 'cheating' WHEN 1 THEN 'unclear' WHEN 2 THEN 'clean' ELSE 'none' END AS verdict FROM orders),
b AS (SELECT * FROM r UNION ALL SELECT NULL, * EXCLUDE map FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY pct, entity) - 1 AS i, count(*) OVER (PARTITION BY map) AS n FROM b)
SELECT map, count(*) AS entities, count(*) FILTER (flagged) AS flagged, count(*) FILTER (pct >= 0.9) AS by_score, count(*) FILTER (ruled) AS ruled,
  count(*) FILTER (verdict = 'cheating') AS cheating, count(*) FILTER (verdict = 'unclear') AS unclear, count(*) FILTER (verdict = 'clean') AS clean,
  count(*) FILTER (verdict = 'none') AS none, count(*) FILTER (held) AS held, CAST(max(pct) FILTER (i = floor(n * 0.5)) AS DOUBLE) AS median,
  CAST(max(pct) FILTER (i = floor(n * 0.9)) AS DOUBLE) AS p90 FROM k GROUP BY map""",
)
def population_summary(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    turn = key % 4
    reports = A.table(spark, d, "orders").select(
        F.concat(F.lit("m"), (key % 5).cast("string")).alias("map"),
        key.alias("entity"),
        (key % 7 == 0).alias("flagged"),
        (key % 11 == 0).alias("ruled"),
        (key % 13 == 0).alias("held"),
        F.when(cust % 9 > 0, (cust % 100) / 100.0).alias("percentile"),
        F.when(turn == 0, "cheating").when(turn == 1, "unclear").when(turn == 2, "clean").alias("verdict"),
    )
    return E.population_summary(reports)


@query(
    "session_id:l text:s",
    """WITH e AS (SELECT user_id // 10 AS session_id, user_id AS entity_id, 'u' || user_id AS name, count(*) AS n,
    count(*) FILTER (event_type = 'error') > 11 AS flagged, CASE WHEN user_id % 3 > 0 THEN (count(*) % 8) / 4.0 END AS score
  FROM events GROUP BY user_id),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY flagged DESC, score DESC NULLS LAST, CAST(entity_id AS VARCHAR)) AS place,
    score IS NOT NULL AND n % 7 < 3 AS few, CASE WHEN score IS NOT NULL THEN score / 2 END AS pc FROM e),
l AS (SELECT *, CASE WHEN flagged THEN '! ' ELSE '  ' END || rpad(name, 22, ' ') || lpad(CAST(n AS VARCHAR), 6, ' ')
    || lpad(coalesce(format('{:.2f}', score), '-') || CASE WHEN few THEN '*' ELSE '' END, 8, ' ') || '  '
    || CASE WHEN pc IS NULL THEN '-' WHEN pc >= 0.99 THEN 'top 1%' ELSE 'top ' || CAST(greatest(1, CAST(round_even((1 - pc) * 100, 0) AS INTEGER)) AS VARCHAR) || '%' END AS line,
    CASE WHEN flagged THEN '! ' || name || ': errors; many' END AS why FROM p)
SELECT session_id, '  ' || rpad('entity', 22, ' ') || ' kills   score  of clean' || chr(10) || string_agg(line, chr(10) ORDER BY place)
  || CASE WHEN bool_or(few) THEN chr(10) || '* few windows' ELSE '' END
  || coalesce(chr(10) || string_agg(why, chr(10) ORDER BY place), '') AS text FROM l GROUP BY session_id""",
)
def session_text(spark, d):
    n = F.count(F.lit(1))
    users = A.table(spark, d, "events").groupBy("user_id").agg(
        n.alias("kills"), (F.count_if(F.col("event_type") == "error") > 11).alias("flagged")
    )
    score = F.when(F.col("user_id") % 3 > 0, (F.col("kills") % 8) / 4.0)
    entities = users.select(
        F.floor(F.col("user_id") / 10).cast("long").alias("session_id"),
        F.col("user_id").alias("entity_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"),
        "kills",
        (F.col("kills") % 7).alias("n_windows"),
        score.alias("score"),
        (score / 2).alias("percentile"),
        "flagged",
        F.array(F.lit("errors"), F.lit("many")).alias("flag_reasons"),
    )
    return Z.session_text(entities, min_windows=3)


@query(
    "event_id:l fold:l",
    """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS place FROM events GROUP BY 1)
SELECT event_id, CASE WHEN place % 10 < 5 THEN place % 10 ELSE 9 - place % 10 END AS fold FROM events JOIN g USING (user_id)""",
)
def balanced_folds(spark, d):
    events = A.table(spark, d, "events").select("event_id", "user_id")
    return U.balanced_folds(events, "user_id")


@query(
    "event_id:l fold:l",
    """SELECT event_id, ('0x' || substr(md5(user_id || '/0'), 1, 8))::UBIGINT % 5 AS fold FROM events""",
)
def group_folds(spark, d):
    events = A.table(spark, d, "events").select("event_id", "user_id")
    return U.group_folds(events, "user_id")


@query(
    "doc_id:l half:l turn:l",
    f"""WITH {_SCORED}
SELECT doc_id, (NOT flag)::INT AS half, row_number() OVER (PARTITION BY flag, lang, source ORDER BY md5(doc_id || '/0'), doc_id) AS turn
FROM scored""",
)
def interleave_strata(spark, d):
    return U.interleave(scored(spark, d), ["lang", "source"], "doc_id", F.col("flag"))


@query(
    "doc_id:l priority:l n_chars:l",
    """SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END AS priority,
  CASE WHEN l.doc_id IS NULL THEN n_chars END AS n_chars
FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def priority_union(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    labels = A.table(spark, d, "labels").select("doc_id", "quality")
    return U.priority_union([labels, docs], ["doc_id"])


@query(
    "doc_id:l n_chars:d quality:l",
    """SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, NULL AS quality FROM documents
UNION ALL SELECT doc_id, quality + 0.5, quality FROM labels""",
)
def schema_union(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    labels = A.table(spark, d, "labels").select(
        "doc_id", (F.col("quality") + 0.5).alias("n_chars"), "quality"
    )
    return U.schema_union([docs, labels])


@query(
    "doc_id:l",
    """SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""",
)
def names_not_listed(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id")
    return docs.join(A.table(spark, d, "labels"), "doc_id", "left_anti")


@query(
    "doc_id:l label:s priority:l score:d",
    f"""WITH {_SCORED},
l AS (SELECT *, CASE WHEN flag THEN 'cheater' ELSE 'clean' END AS label FROM scored),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '/0'), doc_id) AS rn FROM l),
h AS (SELECT * FROM l WHERE label = 'clean' ORDER BY score DESC NULLS LAST, doc_id LIMIT 15)
SELECT doc_id, label, 0 AS priority, score FROM s WHERE rn <= 30
UNION ALL SELECT doc_id, label, 1, score FROM h WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE rn <= 30)""",
)
def case_selection(spark, d):
    rows = scored(spark, d).withColumn(
        "label", F.when(F.col("flag"), "cheater").otherwise("clean")
    )
    return U.case_selection(
        rows.select("doc_id", "label", "score"),
        "doc_id",
        "score",
        per_label=30,
        hard=15,
    )


@query(
    "doc_id:l score:d",
    f"""WITH {_SCORED} SELECT doc_id, score FROM scored WHERE NOT flag
ORDER BY score DESC NULLS LAST, doc_id LIMIT 25""",
)
def hard_negatives(spark, d):
    rows = scored(spark, d).withColumn(
        "label", F.when(F.col("flag"), "cheater").otherwise("clean")
    )
    return U.hard_negatives(rows, "score", 25, key="doc_id")


@query(
    "conv_id:l turn:l unseen:s",
    r"""WITH t AS (SELECT conv_id, turn, text AS sentence, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence, role FROM conversations),
a AS (SELECT conv_id, turn, regexp_extract_all(replace(sentence, ',', ''), '\d+(?:\.\d+)?%?') AS said,
    regexp_extract_all(replace(coalesce(evidence, ''), ',', ''), '\d+(?:\.\d+)?%?') AS shown FROM t WHERE role = 'assistant'),
b AS (SELECT *, list_concat(shown, list_transform(list_filter(shown, lambda n: NOT ends_with(n, '%') AND CAST(n AS DOUBLE) <= 1),
    lambda n: CAST(CAST(round_even(CAST(n AS DOUBLE) * 100, 0) AS INTEGER) AS VARCHAR) || '%')) AS known FROM a)
SELECT conv_id, turn, array_to_string(list_filter(said, lambda n:
    NOT (regexp_matches(rtrim(n, '%'), '^\d+$') AND length(ltrim(rtrim(n, '%'), '0')) < 2)
    AND NOT list_contains(known, n) AND NOT list_contains(known, rtrim(n, '%'))), '|') AS unseen FROM b""",
)
def unseen_numbers(spark, d):
    turns = neighbours(
        A.table(spark, d, "conversations"),
        ["conv_id"],
        tick_chunk("turn", 1024),
        ["turn"],
        back={"evidence": "text"},
    ).withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return turns.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.array_join(unseen(F.col("text"), F.col("evidence")), "|").alias("unseen"),
    )


_ANSWERS_SQL = f"""WITH {_SCORED},
a AS (SELECT source AS judge, doc_id, CASE WHEN flag THEN 'cheater' ELSE 'clean' END AS label,
    CASE WHEN n_chars % 10 = 0 THEN 'invalid' WHEN n_chars > 1200 THEN 'cheating' WHEN n_chars > 300 THEN 'unclear' ELSE 'clean' END AS verdict,
    CASE WHEN n_chars > 1000 THEN 'cheating' WHEN n_chars > 400 THEN 'unclear' ELSE 'clean' END AS target_verdict,
    least(100, n_chars // 20) AS probability, least(95, n_chars // 25) AS target_probability,
    score / (score + 1000) AS s, (n_chars % 13 = 0)::INT AS invented, n_chars % 7 AS seconds FROM scored),
v AS (SELECT *, rank() OVER (PARTITION BY judge ORDER BY probability) + (count(*) OVER (PARTITION BY judge, probability) - 1) / 2.0 AS rk
  FROM a WHERE verdict <> 'invalid'),
c AS (SELECT judge, corr(probability, target_probability) AS pt, corr(probability, s) AS ps, corr(s, target_probability) AS st,
    avg((verdict = target_verdict)::INT) AS matches_target, avg((verdict = 'cheating')::INT) FILTER (label = 'clean') AS accuses_clean,
    avg((verdict = 'cheating')::INT) FILTER (label = 'cheater') AS convicts_listed, avg((verdict = 'unclear')::INT) AS unclear,
    avg(((label = 'cheater') = (verdict = 'cheating'))::INT) FILTER (verdict <> 'unclear') AS right_when_committing, sum(invented) AS invented,
    (sum(rk) FILTER (label = 'cheater') - count(*) FILTER (label = 'cheater') * (count(*) FILTER (label = 'cheater') + 1) / 2.0)
      / nullif(count(*) FILTER (label = 'cheater') * count(*) FILTER (label = 'clean'), 0) AS auc FROM v GROUP BY 1),
g AS (SELECT judge, count(*) AS answers, avg((verdict <> 'invalid')::INT) AS valid, quantile_cont(seconds, 0.5) AS seconds_median FROM a GROUP BY 1)
SELECT *, pt AS follows_evidence, (ps - pt * st) / sqrt((1 - pt * pt) * (1 - st * st)) AS leans_on_score FROM g JOIN c USING (judge)"""


@query(
    "judge:s answers:l valid:d matches_target:d accuses_clean:d convicts_listed:d "
    "unclear:d right_when_committing:d auc:d follows_evidence:d leans_on_score:d "
    "invented:l seconds_median:d",
    _ANSWERS_SQL,
)
def answer_summary(spark, d):
    n = F.col("n_chars")
    verdict = (
        F.when(n % 10 == 0, "invalid")
        .when(n > 1200, "cheating")
        .when(n > 300, "unclear")
        .otherwise("clean")
    )
    target = F.when(n > 1000, "cheating").when(n > 400, "unclear").otherwise("clean")
    rows = scored(spark, d).select(
        F.col("source").alias("judge"),
        F.when(F.col("flag"), "cheater").otherwise("clean").alias("label"),
        verdict.alias("verdict"),
        target.alias("target_verdict"),
        F.least(F.lit(100), F.floor(n / 20)).alias("probability"),
        F.least(F.lit(95), F.floor(n / 25)).alias("target_probability"),
        (F.col("score") / (F.col("score") + 1000)).alias("score"),
        (n % 13 == 0).cast("int").alias("invented"),
        (n % 7).alias("seconds"),
    )
    return E.answer_summary(rows)


@query(
    "covered:l cases:l share:d",
    """SELECT count(l.doc_id) AS covered, count(*) AS cases, count(l.doc_id) / count(*) AS share
FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def answer_coverage(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id")
    return E.coverage(A.table(spark, d, "labels"), docs, ["doc_id"])


@query(
    "lang:s n:l r:d",
    f"""WITH {_SCORED} SELECT lang, count(*) AS n, corr(score, y::INT) AS r FROM scored WHERE NOT flag GROUP BY 1""",
)
def subgroup_correlation(spark, d):
    rows = scored(spark, d).filter(~F.col("flag")).withColumn("_y", F.col("y").cast("int"))
    return E.subgroup_correlation(rows, "score", "_y", ["lang"])
