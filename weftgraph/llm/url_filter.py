"""URL filtering by listed rules and by mined association rules. DataFrame functions alone.

Listed rules (host suffix and path prefix, the longest wins) decide first. What they
leave is decided by association rules: Spark's FP-growth mines combinations of URL
tokens together with the label "blocked" from labelled URLs; rules pruned by support and
confidence, and those that a more general rule makes redundant, block what they match.

Every part of a URL gives a token: scheme, top-level domain, domain, host, each label of
the host, each path segment (the first two by place as well), file extension, each query
key and each query value; digits of segments and values are generalised. Nothing of a URL
is left out. FP-growth sees only tokens that rules may need, which changes no rule: not
those too rare among blocked URLs, those of all URLs, those that block alone with
certainty (a rule each), nor, of tokens that are always seen together, any but one; rules
are written out for the others afterwards. What is left is held down by support alone: a
common kind of URL with m tokens that come and go has up to 2^m combinations. Support is
a share of the labelled URLs and never fewer than ``LEAST`` blocked ones, so that one page
makes no rule in a small table. Rules are
matched through an inverted index (token -> rule) against the distinct token sets of the
URLs, however many URLs share one; a written table of matched sets is joined back, which
is small or else split by adaptive execution.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens
and so the default verdict, allow. With no labelled rows, or none blocked, nothing is
mined. Repeated rows are judged row by row; an empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

SUPPORT, LEAST, CONFIDENCE, LIFT = 0.002, 5, 0.6, 1.5
BLOCKED = "label=blocked"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of a URL; both empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; rules are (verdict, 'host/path')."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + prefix)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of all parts of a URL."""
    host, path = host_path(url)
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    general = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = F.array(
        F.concat(F.lit("scheme="), F.regexp_extract(url, "^[^:]*", 0)),
        F.concat(F.lit("tld="), F.element_at(labels, -1)),
        F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")),
        F.concat(F.lit("host="), host),
        F.concat(F.lit("first="), general(F.try_element_at(segments, F.lit(1)))),
        F.concat(F.lit("second="), general(F.try_element_at(segments, F.lit(2)))),
        F.concat(F.lit("ending="), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1), F.lit(""))),
    )
    all_ = F.concat(
        F.filter(parts, lambda x: x.isNotNull()),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("label="), x)),
        F.transform(segments, lambda x: F.concat(F.lit("segment="), general(x))),
        F.transform(query, lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^[^=]*", 0))),
        F.transform(F.filter(query, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("value="), general(x))),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(all_))).otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, url: str = "url", blocked: str = "blocked", support: float = SUPPORT,
          confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> DataFrame:
    """rule (a number), antecedent, confidence, support of the rules that block, each seen on `least` blocked URLs or more."""
    none = F.array().cast("array<string>")
    rows = labelled.where(F.col(blocked).isNotNull()).select(tokens(F.col(url)).alias("tokens"), F.col(blocked).alias("blocked"))
    rows = stored(rows.where("blocked or size(tokens) > 0").withColumn("id", F.xxhash64("tokens")), "labelled")
    n, n_blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
    needed = max(1, least, math.ceil(support * n))
    sets = stored(rows.groupBy("id", "tokens").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")), "sets")
    # what each token is in: two hashes over the sets tell which tokens are always together
    held = sets.select("id", F.xxhash64("tokens", F.lit(1)).alias("more"), "n", "b", F.explode("tokens").alias("token"))
    facts = held.groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.bit_xor("id").alias("x"), F.bit_xor("more").alias("y"))
    facts = stored(facts.where(F.col("b") >= needed), "tokens")  # at most tokens of a URL / support
    classes = facts.where((F.col("b") < F.col("n")) & ((F.col("n") < n) | F.lit(lift <= 1)))
    classes = stored(classes.groupBy("n", "b", "x", "y").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("alike")).select("token", "alike"), "classes")
    kept = sets.select("id", F.explode("tokens").alias("token")).join(F.broadcast(classes.select("token")), "token")
    kept = stored(kept.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("kept")), "kept")
    items = F.concat(F.coalesce("kept", none), F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(none))
    baskets = stored(rows.select("id", "blocked").join(kept, "id", "left").select(items.alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / max(n, 1)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent")[0] == BLOCKED) & (F.col("lift") >= lift))
    named = F.array_sort("antecedent")
    rules = stored(rules.select(F.xxhash64(named).alias("rule"), named.alias("antecedent"), "confidence", "support"), "rules")
    # a rule is redundant if a part of its antecedent blocks with no less confidence
    index = rules.select("rule", "confidence", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    wide = index.select(F.col("rule").alias("wider"), F.col("confidence").alias("sure"), F.col("need").alias("more"), "token")
    within = index.join(wide, "token").where("need < more and confidence >= sure").groupBy("rule", "need", "wider").count()
    least = rules.join(within.where("count = need").select(F.col("wider").alias("rule")).distinct(), "rule", "left_anti")
    # each token of a rule stands for all that are alike
    index = least.select("rule", "confidence", "support", F.explode("antecedent").alias("token")).join(F.broadcast(classes), "token")
    lists = index.groupBy("rule", "confidence", "support").agg(F.collect_list("alike").alias("lists"))
    one = F.aggregate("lists", F.array(none), lambda done, alike: F.flatten(F.transform(done, lambda x: F.transform(alike, lambda t: F.concat(x, F.array(t))))))
    out = lists.select(F.explode(one).alias("antecedent"), "confidence", "support")
    alone = facts.where((F.col("b") == F.col("n")) & F.lit(confidence <= 1 and n >= lift * n_blocked))
    alone = alone.select(F.array("token").alias("antecedent"), F.lit(1.0).alias("confidence"), (F.col("b") / F.lit(max(n, 1))).alias("support"))
    out = out.unionByName(alone).withColumn("antecedent", F.array_sort("antecedent"))
    return stored(out.select(F.xxhash64("antecedent").alias("rule"), "antecedent", "confidence", "support"), "rules")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of rows (id, tokens) those ids whose tokens contain a rule's antecedent, with the smallest such rule."""
    index = rules.select("rule", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    hits = sets.select("id", F.explode("tokens").alias("token")).join(index, "token")
    full = hits.groupBy("id", "rule", "need").count().where(F.col("count") == F.col("need"))
    return full.groupBy("id").agg(F.min("rule").alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined_rules: DataFrame, url: str = "url") -> DataFrame:
    """pages as `row`, with host, path, rule (listed, or null), mined (rule, or null) and verdict."""
    host, path = host_path(F.col("url"))
    row = pages.select(F.struct("*").alias("row"), F.col(url).cast("string").alias("url"))
    row = row.select("row", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    row = row.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    open_ = row.where(F.col("listed").isNull() & (F.size("tokens") > 0))
    sets = open_.select("tokens").groupBy("tokens").agg(F.count("*").alias("n")).select(F.xxhash64("tokens").alias("id"), "tokens")
    hit = stored(matched(sets, mined_rules), "matched")
    out = row.withColumn("id", F.xxhash64("tokens")).join(hit, "id", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("row", "host", "path", F.col("listed.rule").alias("rule"), F.when(F.col("listed").isNull(), F.col("mined")).alias("mined"), verdict.alias("verdict"))
