"""URL verdicts from fixed rules and mined token combinations. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Host, path and verdict of the rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path of each page; both empty for null or without ``://``."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    rest = rows.withColumn("rest", _rest(F.col("url")))
    host = F.regexp_extract("rest", "^([^/?#]*)", 1)
    split = rest.withColumn("raw", host).withColumn("path", F.regexp_extract(F.expr("substring(rest, char_length(raw) + 1)"), "^([^?#]*)", 1))
    return split.select("page_id", "url", F.translate("raw", _UPPER, _LOWER).alias("host"), "path")


def fixed_rule(rules=RULES) -> Column:
    """The longest rule that fits ``host`` (or a domain above it) and the path's beginning, as a struct."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens() -> Column:
    """Distinct tokens of host, path and query: labels, domain, segments, extension, query keys, fragment."""
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    parts = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.array(F.concat(F.lit("domain="), F.array_join(F.slice(F.reverse(labels), 1, 2), "."))),
        F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0"))),
        F.array(F.concat(F.lit("type="), F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1))),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1))),
        F.when(F.instr("url", "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(parts, lambda x: ~x.endswith("=")))


def mine_rules(tokens: DataFrame, labels: DataFrame, least_support: float = 0.002, least_rows: int = 20, confidence: float = 0.8) -> DataFrame:
    """Token combinations that say bad: rule_id, antecedent, confidence, support.

    Baskets are the tokens of pages whose page_id is a labelled doc_id, with one more token where
    the label is bad (quality 0 or toxic 1). FP-growth mines them; rules to the bad token stay from
    ``confidence`` and support on (``least_support`` of the baskets and ``least_rows`` of them); a
    rule goes if a part of it is a rule, which blocks all that it would. All others are returned,
    whatever their number. Tokens that the same labelled pages hold are one item of the mining, as any
    of them makes the same rules: each part of an antecedent lists the tokens of which one will do.
    No labelled pages: no rules.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marked = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
    baskets = cut(tokens.join(marked, "page_id").select(F.monotonically_increasing_id().alias("basket"), "tokens", "bad"))
    counts = baskets.agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 1).alias("bad")).first()
    if not counts["bad"]:
        return tokens.sparkSession.createDataFrame([], "rule_id long, antecedent array<array<string>>, confidence double, support double")
    support = min(1.0, max(least_support, least_rows / counts["n"]))
    # 128 bits tell the sets of baskets apart that hold a token
    held = baskets.select("basket", F.explode("tokens").alias("token"))
    prints = [F.bit_xor(F.xxhash64("basket", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sets = held.groupBy("token").agg(F.count("*").alias("n"), *prints).where(F.col("n") >= support * counts["n"])
    classes = cut(sets.groupBy("n", "x1", "x2").agg(F.array_sort(F.collect_list("token")).alias("any")).select(F.col("any")[0].alias("item"), "any"))
    first = held.join(classes.select("item"), F.col("token") == F.col("item"))
    items = first.groupBy("basket").agg(F.collect_list("item").alias("items"))
    rows = baskets.select("basket", "bad").join(items, "basket", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    least = least_rules(cut(rules.select(F.monotonically_increasing_id().alias("rule_id"), "antecedent", "confidence", "support")))
    parts = least.select("rule_id", "confidence", "support", F.explode("antecedent").alias("item")).join(classes, "item")
    return parts.groupBy("rule_id").agg(F.array_sort(F.collect_list("any")).alias("antecedent"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))


def least_rules(rules: DataFrame) -> DataFrame:
    """The rules that hold no other rule's items among theirs, by rounds from short to long ones."""
    kept, left = rules.limit(0), rules
    while (size := left.agg(F.min(F.size("antecedent"))).first()[0]) is not None:
        least = left.where(F.size("antecedent") == size)
        kept, longer = kept.unionByName(least), left.where(F.size("antecedent") > size)
        single = least.withColumn("antecedent", F.transform("antecedent", lambda x: F.array(x)))
        covered = match_rules(longer.select(F.col("rule_id").alias("page_id"), F.col("antecedent").alias("tokens")), single)
        left = cut(longer.join(covered.withColumnRenamed("page_id", "rule_id"), "rule_id", "left_anti"))
    return kept


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """page_ids with a token of each part of a rule, by an inverted index of the rules' tokens."""
    parts = rules.select("rule_id", F.size("antecedent").alias("size"), F.posexplode("antecedent").alias("part", "any"))
    index = parts.select("rule_id", "size", "part", F.explode("any").alias("token"))
    hits = tokens.select("page_id", F.explode("tokens").alias("token")).join(index, "token")
    whole = hits.groupBy("page_id", "rule_id").agg(F.count_distinct("part").alias("n"), F.first("size").alias("size")).where("n = size")
    return whole.select("page_id").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A fixed rule's verdict stands; where none fits, mined rules block and all else is allowed.
    Null urls have empty host and path and no tokens. Pages with a null page_id are judged by the
    fixed rules and else allowed; rows that share a page_id are blocked together by mined rules.
    Long urls are read whole. Empty tables give no rows; other columns are not read.
    """
    split = split_urls(pages)
    judged = split.withColumn("found", fixed_rule(rules))
    open_pages = judged.where("found is null").select("page_id", url_tokens().alias("tokens"))
    mined = mine_rules(split.select("page_id", url_tokens().alias("tokens")), labels, **options)
    blocked = match_rules(open_pages, mined).withColumn("blocked", F.lit(True))
    out = judged.join(blocked, "page_id", "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
