"""URL verdicts from stated rules and, for the rest, from mined association rules.

A stated rule names a host and a path prefix; it fits the host and its subdomains, and the
longest that fits decides.  The URLs that a rule decides are the labels: Spark's FP-growth mines
combinations of URL tokens that go with ``block`` or ``allow``.  Mined rules are pruned by
support and confidence, and a rule is dropped if a part of it already tells the same at least as
surely.  They are matched by an inverted index: each rule is filed under its rarest token, so a
URL meets only the rules filed under its own tokens, and those are kept whose tokens it has all.
The surest rule decides, then the better supported, the longer and the first by name; where none
fits, the verdict is ``allow``.

Verdicts depend on the URL only and are made once for each distinct one.  A null URL or one
without ``://`` has an empty host and path and no tokens; repeated rows get the same verdict; an
empty table gives no rows; other columns are ignored.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.plans.staging import staged

#: (verdict, rule): host and path prefix as one string.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
SUPPORT, CONFIDENCE, LONGEST = 0.01, 0.8, 3
RULE = "tokens array<string>, verdict string, confidence double, support double"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels and words, path parts, query keys.

    Digits within a path part count as one sign, so numbered pages share tokens.
    """
    host, path, rest = host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind + ":"), p))

    labels = F.split(host, r"\.")
    found = F.concat(
        named("scheme", F.array(F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("")), _UPPER, _LOWER))),
        named("label", labels),
        named("word", F.split(host, r"[.-]")),
        named("path", F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, "[0-9]+", "#"))),
        named("query", F.transform(F.split(F.regexp_extract(rest, r"^\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))),
    )
    return F.array_sort(F.array_distinct(found))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """``(tokens, verdict, confidence, support)`` of the pruned rules, from ``tokens`` and ``verdict``.

    Rules of up to ``longest`` tokens that conclude a verdict, however many, stay a table.  Every
    set of frequent tokens of a URL would be mined, so those that can only make rules that pruning
    drops are kept out: tokens of the same URLs stand in for each other, one of each such class
    goes to the mining, and the rules found are written out for all of the class; a token of
    every URL adds nothing to a set, and a token that already tells a verdict for sure is a rule
    itself, which no set with it can better.
    """
    rows = labelled.select(F.array_distinct("tokens").alias("tokens"), "verdict").withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "labelled")
    n = rows.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], RULE)
    uses = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    where = F.sum(F.xxhash64("row").cast("decimal(38,0)")), F.sum(F.xxhash64(F.col("row"), F.lit("again")).cast("decimal(38,0)"))
    tokens = uses.groupBy("token").agg(F.count(F.lit(1)).alias("n"), where[0].alias("a"), where[1].alias("b"), *[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("block", "allow")])
    least = support * n
    tokens = staged(tokens.where(F.col("n") >= F.ceil(F.lit(least))), "url-tokens")  # 1 / support times the tokens of a URL at most
    classes = tokens.groupBy("n", "a", "b", "block", "allow").agg(F.min("token").alias("one"), F.collect_list("token").alias("all"))
    classes = staged(classes, "url-token-classes")
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("k")) for v in ("block", "allow")])).alias("x")
    single = classes.select("one", "n", sides).select(F.array("one").alias("tokens"), "x.verdict", (F.col("x.k") / F.col("n")).alias("confidence"), (F.col("x.k") / F.lit(n)).alias("support"), "x.k")
    single = single.where((F.col("k") >= F.ceil(F.lit(least))) & (F.col("confidence") >= confidence)).drop("k")
    open_tokens = classes.where((F.col("n") < n) & (F.greatest("block", "allow") < F.col("n"))).select(F.col("one").alias("token"))
    baskets = uses.join(open_tokens, "token").groupBy("row", "verdict").agg(F.collect_list("token").alias("tokens"))
    baskets = rows.select("row", "verdict").join(baskets.select("row", "tokens"), "row", "left")  # support counts all labelled URLs
    baskets = baskets.select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    found = found.where(F.element_at("consequent", 1).startswith("verdict=") & (F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda t: t.startswith("verdict=")))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 9, 99).alias("verdict"), "confidence", "support")
    found = staged(found.where(F.size("tokens") > 1).unionByName(single), "url-rules")
    part = F.explode(F.expr("transform(sequence(1, shiftleft(1, size(tokens)) - 2), m -> filter(tokens, (t, i) -> shiftright(m, i) % 2 = 1))")).alias("part")
    parts = found.where("size(tokens) > 1").select("tokens", "verdict", "confidence", part)
    known = found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"))
    needless = parts.join(known, ["part", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(needless, ["tokens", "verdict"], "left_anti").withColumn("out", F.array().cast("array<string>"))
    for i in range(longest):  # each token's whole class in its place
        member = F.when(F.size("tokens") > i, F.coalesce("all", F.array(F.get("tokens", F.lit(i))))).otherwise(F.array(F.lit(None).cast("string")))
        at = F.get("tokens", F.lit(i))
        kept = kept.join(classes.select("one", "all"), at == F.col("one"), "left").withColumn("token", F.explode(member))
        kept = kept.withColumn("out", F.when(F.col("token").isNull(), F.col("out")).otherwise(F.array_append("out", F.col("token")))).drop("one", "all", "token")
    return kept.select(F.array_sort("out").alias("tokens"), "verdict", "confidence", "support")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> list[tuple]:
    """The rows of ``mined_rules``, for small tables."""
    return [tuple(r) for r in mined_rules(labelled, support, confidence, longest).collect()]


def match(urls: DataFrame, rules: DataFrame | list[tuple]) -> DataFrame:
    """``(url, mined)``: the verdict of the surest rule for the URLs (with ``tokens``) that one fits."""
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(rules, RULE)
    rules = rules.select(F.col("tokens").alias("needs"), F.col("verdict").alias("mined"), "confidence", "support")
    uses = rules.withColumn("token", F.explode("needs"))
    many = uses.groupBy("token").agg(F.max("support").alias("many"))
    index = uses.join(many, "token").groupBy(*rules.columns).agg(F.min_by("token", F.struct("many", "token")).alias("token"))
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max_by("mined", F.struct("confidence", "support", F.size("needs"), F.concat_ws(" ", "needs"), "mined"))
    return met.groupBy("url").agg(best.alias("mined"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every page."""
    url = F.col("url")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    rule, said = stated(host_of(url), path_of(url), rules)
    labelled = rows.select(tokens_of(url).alias("tokens"), said.alias("verdict")).where("verdict is not null")
    found = staged(mined_rules(labelled, support, confidence), "url-rules-pruned")
    open_urls = rows.select("url").where("url is not null").where(said.isNull()).distinct().withColumn("tokens", tokens_of(url))
    mined = staged(match(open_urls, found), "url-verdicts")  # a table: a popular url's join can be split
    judged = rows.join(mined, "url", "left")
    return judged.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), rule.alias("rule"), F.coalesce(said, F.col("mined"), F.lit("allow")).alias("verdict"))
