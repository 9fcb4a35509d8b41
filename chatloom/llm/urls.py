"""URL filter: a rule list, then the ratio of two character language models, in DataFrame operations alone.

The URLs that a rule accepts or rejects train one variable-order Markov model each (contexts of up to four characters,
Witten-Bell smoothing from every order to the next lower one). Every other URL is judged by the mean difference of the
two log-probabilities per character, against a threshold calibrated on labelled URLs that neither model has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import KEY, UPPER, Query, ascii_lower, pinned, table, text_key
from chatloom.session import materialise

# (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_RULES = 1000
ORDER = 4
# One labelled URL in five calibrates the threshold, by a hash of the URL.
FOLDS = 5
# Hot grams (as `.com/`) occur in most URLs, so the table of grams is dealt out this many times.
SALT = 16
BEGIN, END = "\u0002", "\u0003"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def url_parts(url: Column) -> dict[str, Column]:
    """host, path and the rest behind them; all empty for null or where no `://` is."""
    whole = F.coalesce(url, F.lit(""))
    return {"host": ascii_lower(F.regexp_extract(whole, PARTS, 1)), "path": F.regexp_extract(whole, PARTS, 2),
            "rest": F.regexp_extract(whole, PARTS, 3)}


def rule_columns(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule (as `host` + `path`) and its verdict, or nulls. Of equal rules the first wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule list holds up to {MAX_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, said).otherwise(verdict)
    return name, verdict


def gram_ratio(grams: DataFrame, order: int) -> DataFrame:
    """`gram`, `ratio`: log P(accepted) - log P(rejected) of the last character after the others.

    `grams` holds each gram once, with its counts `yes` and `no` in the training URLs (0 where it isn't in them).
    """
    lower = None
    for k in range(order + 1):
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        after = Window.partitionBy(F.left("gram", F.lit(k)))
        for side in ("yes", "no"):
            level = level.withColumns({
                f"{side}_all": F.sum(side).over(after), f"{side}_kinds": F.sum((F.col(side) > 0).cast("long")).over(after),
            })
        if lower is None:
            level = level.withColumns({"yes_low": 1.0 / F.count("*").over(after), "no_low": 1.0 / F.count("*").over(after)})
        else:
            level = level.withColumn("_low", F.right("gram", F.lit(k))).join(lower, "_low")
        lower = level.select("gram", *(
            F.when(F.col(f"{s}_all") == 0, F.col(f"{s}_low"))
            .otherwise((F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_low")) / (F.col(f"{s}_all") + F.col(f"{s}_kinds"))).alias(s)
            for s in ("yes", "no")
        ))
        if k < order:
            lower = lower.select(F.col("gram").alias("_low"), F.col("yes").alias("yes_low"), F.col("no").alias("no_low"))
    return lower.select("gram", (F.ln("yes") - F.ln("no")).alias("ratio"))


def best_threshold(scored: DataFrame) -> float:
    """The score from which URLs are accepted: best mean of the two classes' hit rates; 0 where a class is missing.

    Of equal thresholds the one nearest to 0 wins, then the lower. Scores are counted in thousandths first, so the
    table that is ordered has as many rows as there are different rounded scores, whatever the input.
    """
    bins = scored.groupBy(F.round("score", 3).alias("at")).agg(
        F.count(F.when(F.col("label") == "allow", 1)).alias("yes"), F.count(F.when(F.col("label") == "block", 1)).alias("no")
    )
    whole, below = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        "at", F.sum("yes").over(whole).alias("yes_all"), F.sum("no").over(whole).alias("no_all"),
        F.coalesce(F.sum("yes").over(below), F.lit(0)).alias("yes_below"), F.coalesce(F.sum("no").over(below), F.lit(0)).alias("no_below"),
    ).where("yes_all > 0 and no_all > 0")
    rate = F.col("no_below") / F.col("no_all") + (F.col("yes_all") - F.col("yes_below")) / F.col("yes_all")
    best = bins.orderBy(rate.desc(), F.abs("at"), "at").select("at").first()
    return best[0] - 0.0005 if best else 0.0


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """One row per row of `pages`: `id_col`, host, path, rule, verdict, score, by_model.

    `score` is the mean log ratio per character, end mark included. Null, empty and unparsable URLs have empty parts and
    are scored as the empty string. Without labelled URLs every score is 0 and every URL is accepted. Equal URLs get
    equal verdicts; rows with repeated or null ids each keep a row. No other column is read.
    """
    parts = url_parts(F.col("_url"))
    rule, said = rule_columns(rules, F.col("host"), F.col("path"))
    base = pinned(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_id", **parts)
    base = base.withColumns({"rule": rule, "said": said, "_text": F.concat("host", "path", "rest")})
    base = base.withColumns(dict(zip(KEY, text_key(F.col("_text"))))).drop("rest")
    urls = materialise(base.groupBy(*KEY).agg(F.first("_text").alias("_text"), F.first("said").alias("label")), "url-texts")
    held = F.conv(F.left(F.md5("_text"), F.lit(8)), 16, 10).cast("bigint") % FOLDS == 0
    trains = F.col("label").isNotNull() & ~held

    padded = F.concat(F.lit(BEGIN * order), F.col("_text"), F.lit(END))
    chars = pinned(urls, *KEY, trains.alias("_trains"), "label", _chars=F.array_remove(F.split(padded, ""), ""))
    runs = F.transform(F.sequence(F.lit(1), F.size("_chars") - order), lambda i: F.array_join(F.slice("_chars", i, order + 1), ""))
    grams = chars.select(*KEY, "_trains", "label", F.explode(runs).alias("gram"))
    counts = grams.groupBy("gram").agg(
        F.count(F.when(F.col("_trains") & (F.col("label") == "allow"), 1)).alias("yes"),
        F.count(F.when(F.col("_trains") & (F.col("label") == "block"), 1)).alias("no"),
    )
    ratio = gram_ratio(materialise(counts, "url-grams"), order)
    dealt = ratio.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    scores = (
        grams.withColumn("_salt", F.pmod("_k1", F.lit(SALT)).cast("int"))
        .join(dealt, ["gram", "_salt"]).groupBy(*KEY).agg(F.round(F.avg("ratio"), 9).alias("score"))
    )
    scores = materialise(scores, "url-scores")
    threshold = best_threshold(urls.where(F.col("label").isNotNull() & held).join(scores, KEY))
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return base.drop("_text").join(scores, KEY, "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", F.col("said").isNull().alias("by_model")
    )


def op8_markov(spark, sf_dir: str) -> DataFrame:
    """All page URLs."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(k: int) -> str:
    """Counts and smoothed probabilities of the grams of order `k`, after `counts`."""
    over = "OVER (PARTITION BY left(gram, {}))".format(k)
    low = "1.0::DOUBLE / kinds AS yes_low, 1.0::DOUBLE / kinds AS no_low" if k == 0 else "l.yes AS yes_low, l.no AS no_low"
    join = "" if k == 0 else f"JOIN p{k - 1} l ON l.gram = right(n.gram, {k})"
    smooth = ", ".join(
        f"CASE WHEN {x}_all = 0 THEN {x}_low ELSE ({x}_n + {x}_kinds * {x}_low) / ({x}_all + {x}_kinds) END AS {x}" for x in ("yes", "no")
    )
    return f"""
    n{k} AS (SELECT *, sum(yes_n) {over} AS yes_all, sum(no_n) {over} AS no_all, count(*) FILTER (yes_n > 0) {over} AS yes_kinds,
        count(*) FILTER (no_n > 0) {over} AS no_kinds, count(*) {over} AS kinds
      FROM (SELECT right(gram, {k + 1}) AS gram, sum(yes) AS yes_n, sum(no) AS no_n FROM counts GROUP BY 1)),
    p{k} AS (SELECT gram, {smooth} FROM (SELECT n.*, {low} FROM n{k} n {join})),"""


def _sql() -> str:
    """DuckDB SQL of `op8_markov`, the models included."""
    part = "regexp_extract(coalesce(url, ''), '" + PARTS + "', {})"
    rules = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fit = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in rules
    )
    name, said = fit.format(*(h + p for _, h, p in rules)), fit.format(*(v for v, _, _ in rules))
    return f"""
    WITH cut AS (SELECT page_id, translate({part.format(1)}, '{UPPER}', '{UPPER.lower()}') AS host, {part.format(2)} AS path,
        {part.format(3)} AS rest FROM pages),
    base AS (SELECT *, CASE{name} END AS rule, CASE{said} END AS said, host || path || rest AS s FROM cut),
    urls AS (SELECT DISTINCT s, said AS label, ('0x' || left(md5(s), 8))::BIGINT % {FOLDS} = 0 AS held FROM base),
    spans AS (SELECT *, repeat(chr(2), {ORDER}) || s || chr(3) AS padded FROM urls),
    grams AS (SELECT s, label, held, substr(padded, i, {ORDER + 1}) AS gram
      FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM spans)),
    counts AS (SELECT gram, count(*) FILTER (label = 'allow' AND NOT held) AS yes, count(*) FILTER (label = 'block' AND NOT held) AS no
      FROM grams GROUP BY 1),{"".join(_level_sql(k) for k in range(ORDER + 1))}
    scores AS (SELECT s, round(avg(ln(p.yes) - ln(p.no)), 9) AS score FROM grams JOIN p{ORDER} p USING (gram) GROUP BY 1),
    bins AS (SELECT round(score, 3) AS bin, count(*) FILTER (label = 'allow') AS yes, count(*) FILTER (label = 'block') AS no
      FROM urls JOIN scores USING (s) WHERE held AND label IS NOT NULL GROUP BY 1),
    summed AS (SELECT bin, sum(yes) OVER () AS ya, sum(no) OVER () AS na,
        coalesce(sum(yes) OVER b, 0) AS yb, coalesce(sum(no) OVER b, 0) AS nb
      FROM bins WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    best AS (SELECT coalesce((SELECT bin - 0.0005 FROM summed WHERE ya > 0 AND na > 0
      ORDER BY nb / na + (ya - yb) / ya DESC, abs(bin), bin LIMIT 1), 0) AS t)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= (SELECT t FROM best) THEN 'allow' ELSE 'block' END) AS verdict
    FROM base JOIN scores USING (s)"""


QUERIES = {"op8_markov": Query(op8_markov, _sql())}
