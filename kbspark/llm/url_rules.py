"""URL filter: a list of host and path rules, and association rules mined by FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved

#: (host, path, verdict). A rule fits its host and every subdomain, where the path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Least share of the labelled rows that hold a combination, and of those that have its verdict.
SUPPORT = 0.005
CONFIDENCE = 0.9
#: Labelled rows that the rules are mined from, at most; hash order picks them.
SAMPLE = 20_000

BLOCK, ALLOW = "=block", "=allow"
_AUTHORITY = r"^[\s\S]*?://([^/?#]*)"
_PATH = r"^[\s\S]*?://[^/?#]*(/?[^?#]*)"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _AUTHORITY, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, host first, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, labels of the host by place, path
    parts, file ending and query keys, with digits generalised to ``#``."""
    text = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host(url), r"\."))
    plain = F.regexp_replace(path(url), r"[0-9]+", "#")
    parts = F.filter(F.split(plain, "/"), lambda s: s != "")
    keys = F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
        F.transform(labels, lambda s, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), s)),
        F.transform(parts, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s)),
        F.array(F.concat(F.lit("file:"), F.regexp_extract(plain, r"\.([A-Za-z]{1,8})$", 1))),
        F.transform(keys, lambda s: F.concat(F.lit("key:"), s)),
    )))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """(antecedent, verdict, confidence, support) mined from (tokens, verdict).

    At most ``sample`` labelled rows, picked by hash, are mined, so that mining
    costs the same at any size. Tokens below the support cannot be part of a
    rule and are left out first. Rules may have any number of tokens. A rule is pruned
    when a part of its antecedent is a rule for the same verdict with no lower confidence."""
    spark = labelled.sparkSession
    n = labelled.count()
    rows = labelled
    if n > sample:
        rows = labelled.where(F.pmod(F.xxhash64("id", "tokens"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = saved(rows.select(F.concat("tokens", F.array(F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW)))
                             .alias("items")), "url-labelled")
    n = rows.count()
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    if n == 0:
        return empty
    common = (rows.select(F.explode("items").alias("item")).groupBy("item").count()
              .where(F.col("count") >= support * n).select("item"))
    kept = (rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("items").alias("item"))
            .join(common, "item", "left_semi").groupBy("row").agg(F.collect_set("item").alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence,
                     numPartitions=rows.sparkSession.sparkContext.defaultParallelism).fit(saved(kept, "url-items"))
    rules = (model.associationRules
             .where(F.element_at("consequent", 1).isin(BLOCK, ALLOW))
             .select(F.array_sort("antecedent").alias("antecedent"),
                     F.substring(F.element_at("consequent", 1), 2, 10).alias("verdict"), "confidence", "support"))
    rules = saved(rules, "url-rules")
    verdict = F.when(F.array_contains("items", BLOCK), BLOCK).when(F.array_contains("items", ALLOW), ALLOW)
    combinations = saved(model.freqItemsets.select("items", verdict.alias("verdict")).where("verdict is not null")
                         .select(F.array_sort(F.array_remove("items", F.col("verdict"))).alias("antecedent"),
                                 F.substring("verdict", 2, 10).alias("verdict")), "url-combinations")
    return saved(_pruned(rules, combinations), "url-pruned")


def _pruned(rules: DataFrame, combinations: DataFrame) -> DataFrame:
    """Rules of which no part says the same at least as surely.

    Every part of a frequent combination is frequent too. So, from the shortest on, each
    combination, be it a rule or not, learns from those one token shorter how sure the surest
    rule among its parts is, and parts are looked up by equality."""
    longest = combinations.agg(F.max(F.size("antecedent"))).first()[0] or 0
    known = combinations.join(rules, ["antecedent", "verdict"], "left")
    below, kept = None, rules.limit(0)
    for n in range(1, longest + 1):
        level = known.where(F.size("antecedent") == n).withColumn("part_sure", F.lit(None).cast("double"))
        if below is not None:
            parts = level.select("antecedent", "verdict", F.explode("antecedent").alias("token")).select(
                "antecedent", "verdict", F.array_remove("antecedent", F.col("token")).alias("part"))
            surest = parts.join(below, ["part", "verdict"]).groupBy("antecedent", "verdict").agg(F.max("sure").alias("part_sure"))
            level = level.drop("part_sure").join(surest, ["antecedent", "verdict"], "left")
        level = saved(level, "url-level")
        below = level.select(F.col("antecedent").alias("part"), "verdict", F.greatest("confidence", "part_sure").alias("sure"))
        kept = kept.unionByName(level.where("confidence is not null and (part_sure is null or part_sure < confidence)")
                                .select(rules.columns))
    return kept


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) with the verdict of the surest rule that a token set holds.

    The index lists each rule under its rarest token. Ties between rules go to
    the longer one, then to the more frequent, then to block."""
    df = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    places = rules.select("*", F.explode("antecedent").alias("token")).join(df, "token")
    index = places.groupBy("antecedent", "verdict", "confidence", "support").agg(
        F.min(F.struct("df", "token"))["token"].alias("token"))
    held = (token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = F.max(F.struct("confidence", F.size("antecedent").alias("n"), "support", "verdict"))["verdict"]
    return held.groupBy("tokens").agg(best.alias("mined"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          default: str = "allow", **mining) -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    A listed rule decides where one fits. Rows so decided are the labels from
    which association rules are mined; those decide the rest, and ``default``
    stands where none fits. URLs with equal tokens are matched once.
    Missing or malformed URLs have an empty host and path and no rule; repeated
    rows are judged alike; an empty table gives no rows; other columns are ignored."""
    u = F.col("url")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    rows = rows.select("id", host(u).alias("host"), path(u).alias("path"), tokens(u).alias("tokens"))
    rows = rows.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    rows = saved(rows, "url-rows")
    mined_rules = mine(rows.where("listed is not null").select("id", "tokens", F.col("listed.verdict").alias("verdict")),
                       **mining)
    sets = rows.where("listed is null").groupBy("tokens").agg(F.count("*").alias("rows")).select("tokens")
    verdicts = matched(saved(sets, "url-sets"), mined_rules)
    out = rows.join(verdicts, "tokens", "left")
    return out.select(F.col("id").alias(key), "host", "path", F.col("listed.rule").alias("rule"),
                      F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"))
