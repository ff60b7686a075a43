"""Token-budgeted lookup: tiered lexical scores, hub-refusing graph expansion, a budget.

Many queries are answered in one job: `queries` has query_id and text. Terms meet the
distinct tokens that contain them by an equi join on substrings; all else are equi joins
and windows per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import idf, searchable_url, strength, terms, tier, token_cost, tokens
from ..sources.tables import unsigned, written

HOP, LEXICAL, STRUCTURE, RENDER = 0.5, 0.8, 0.2, 12
TEXTS = ("node_key", "url", "title", "snippet")


@dataclass(frozen=True)
class QueryOptions:
    limit: int = 20
    depth: int = 3
    max_seeds: int = 3
    budget: int = 2000
    merged_flags: bool = False  # whether stubs and tombstones are told by the merged view, not the last compaction


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n_terms."""
    found = queries.select("query_id", terms(F.col("text")).alias("terms"))
    return found.select("query_id", F.size("terms").cast("long").alias("n_terms"), F.explode("terms").alias("term"))


def containing(tokens_: DataFrame, terms_: DataFrame) -> DataFrame:
    """term, token of every token that contains a term. tokens_: token, distinct; terms_: term, distinct.

    An equi join: terms meet the substrings of tokens that have a term's length. A token of c
    characters gives c substrings for each length that terms have; lengths are driver-sized.
    """
    lengths = [r[0] for r in terms_.select(F.length("term").alias("n")).distinct().orderBy("n").limit(65).collect()]
    if not lengths:
        return tokens_.join(terms_.limit(0)).select("term", "token")
    if len(lengths) > 64:  # absurdly many: start with the shortest length alone and look at the rest
        least = lengths[0]
        parts = tokens_.select("token", F.explode(_parts(least)).alias("part")).join(terms_.select("term", F.substring("term", 1, least).alias("part")), "part")
        return parts.where(F.contains(F.col("token"), F.col("term"))).select("term", "token").distinct()
    parts = F.array_distinct(F.flatten(F.array(*[_parts(n) for n in lengths])))
    return tokens_.select("token", F.explode(parts).alias("term")).join(terms_, "term").select("term", "token")


def _parts(n: int):
    """All substrings of n characters of `token`."""
    last = F.length("token") - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(F.col("token"), k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contributions(of: DataFrame, postings: DataFrame, n_nodes: int) -> DataFrame:
    """query_id, n_terms, term, node_key, contribution: the best tier times idf, for each term and node.

    Terms are told apart once, and matched with distinct tokens.
    """
    lexicon = postings.groupBy("token").agg(F.count("*").alias("df"))
    distinct = of.select("term").distinct()
    hits = containing(lexicon.select("token"), distinct)
    hits = hits.select("term", "token", tier(F.col("token"), F.col("term")).alias("tier"))
    exact = lexicon.select(F.col("token").alias("term"), "df")
    best = hits.join(postings, "token").groupBy("term", "node_key").agg(F.max("tier").alias("tier"))
    weight = distinct.join(exact, "term", "left").select("term", idf(F.lit(max(n_nodes, 1)), F.coalesce("df", F.lit(0))).alias("idf"))
    scored = best.join(weight, "term").select("term", "node_key", (F.col("tier") * F.col("idf")).alias("contribution"))
    return of.join(scored, "term").select("query_id", "n_terms", "term", "node_key", "contribution")


def _steady_sum(of: Column) -> Column:
    """The sum in ascending order: equal parts give equal sums, whatever order they come in. One value per term, so never many."""
    return F.aggregate(F.array_sort(F.collect_list(of)), F.lit(0.0), lambda held, x: held + x)


def lexical(found: DataFrame) -> DataFrame:
    """query_id, node_key, matched, score: contributions times the squared share of matched terms."""
    summed = found.groupBy("query_id", "node_key", "n_terms").agg(_steady_sum(F.col("contribution")).alias("tiered"), F.count("*").alias("matched"))
    share = F.col("matched") / F.col("n_terms")
    return summed.select("query_id", "node_key", "matched", (F.col("tiered") * share * share).alias("score"))


def seeds(found: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """query_id, node_key, score: the best node of each term, the smallest keys first, then the best scores."""
    key = unsigned(F.col("node_key"))
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_id", "term").orderBy(F.desc("contribution"), key))).where("n = 1")
    best = best.select("query_id", "node_key", F.lit(0).alias("turn")).distinct()
    first = W.partitionBy("query_id").orderBy("turn", F.when(F.col("turn") == 1, -F.col("score")).otherwise(F.lit(0.0)), key)
    both = scores.join(best, ["query_id", "node_key"], "left").withColumn("turn", F.coalesce("turn", F.lit(1)))
    return both.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("query_id", "node_key", "score")


def expand(start: DataFrame, edges: DataFrame, base_nodes: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """query_id, node_key, arrival, seed after `depth` hops. hubs: nodes that are reached but not left, unless seeds."""
    known = base_nodes.select("node_key")
    steps = edges.select(F.col("src_key").alias("node_key"), "dst_key", (F.lit(HOP) * strength(F.col("weight"), F.col("inferred"))).alias("keep"))
    arrival = written(start.select("query_id", "node_key", F.col("score").alias("arrival"), F.lit(True).alias("seed")), "arrival")
    front = arrival
    for _ in range(depth):
        open_ = front.where("seed").unionByName(front.where("not seed").join(hubs, "node_key", "left_anti").select(*front.columns))
        got = open_.join(steps, "node_key").groupBy("query_id", F.col("dst_key").alias("node_key")).agg(F.max(F.col("arrival") * F.col("keep")).alias("new")).join(known, "node_key", "left_semi")
        both = arrival.join(got, ["query_id", "node_key"], "full_outer")
        better = F.col("new").isNotNull() & (F.col("arrival").isNull() | (F.col("new") > F.col("arrival")))
        both = written(both.select("query_id", "node_key", F.when(better, F.col("new")).otherwise(F.col("arrival")).alias("arrival"), F.coalesce("seed", F.lit(False)).alias("seed"), better.alias("moved")), "arrival")
        arrival, front = both.drop("moved"), both.where("moved").drop("moved")
        if front.isEmpty():
            break
    return arrival


def fresh_scores(of: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """query_id, node_key, score of nodes that no compaction has seen; their words are no part of the index."""
    words = nodes.where("not in_base and not is_tombstone and url <> ''").select(
        "node_key", F.explode(F.array_distinct(F.flatten(F.array(tokens(searchable_url(F.col("url"))), tokens(F.col("title")), tokens(F.col("snippet")))))).alias("token")
    )
    hits = containing(words.select("token").distinct(), of.select("term").distinct())
    best = words.join(hits, "token").groupBy("term", "node_key").agg(F.max(tier(F.col("token"), F.col("term"))).alias("tier"))
    scored = best.select("term", "node_key", (F.col("tier") * F.log(F.lit(1.0 + max(n_nodes, 1)))).alias("contribution"))
    return lexical(of.join(scored, "term").select("query_id", "n_terms", "term", "node_key", "contribution")).select("query_id", "node_key", "score")


def anchors(of: DataFrame, hits: DataFrame, segments: DataFrame) -> DataFrame:
    """query_id, node_key, anchor: the heading that matches best, then is most important, then comes first."""
    label = hits.join(segments.select("node_key", "ordinal", "label", "importance"), "node_key").select("query_id", "node_key", "ordinal", "label", "importance", F.explode(tokens(F.col("label"))).alias("word"))
    own = of.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    good = label.join(own, "query_id").where(F.exists("terms", lambda t: F.startswith(F.col("word"), t)))
    counted = good.groupBy("query_id", "node_key", "ordinal", "label", "importance").agg(F.count("*").alias("matches"))
    return counted.groupBy("query_id", "node_key").agg(F.max_by("label", F.struct("matches", "importance", -F.col("ordinal"))).alias("anchor"))


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, segments: DataFrame, postings: DataFrame,
           hub_degree: DataFrame, hub_cut: int, n_base: int, how: QueryOptions = QueryOptions(), texts: DataFrame | None = None) -> DataFrame:
    """query_id, place, node_key, url, title, snippet, anchor, score, seed, cost of each query's hits.

    nodes: the merged view with in_base, base_stub, base_tombstone and permille.
    hub_degree: node_key, degree as of the last compaction.
    texts: node_key, url, title, snippet of what hits show, one row for each document of a key; those of nodes, if not given.
    """
    of = written(query_terms(queries), "terms")
    found = written(contributions(of, postings, n_base), "found")
    scores = written(lexical(found), "scores")
    start = seeds(found, scores, how.max_seeds)
    hubs = hub_degree.where(F.col("degree") >= hub_cut).select("node_key")
    base = nodes.where("in_base")
    arrival = expand(start, edges, hub_degree.select("node_key"), hubs, how.depth)
    top = arrival.groupBy("query_id").agg(F.max("arrival").alias("top"))
    shown = "not is_stub and not is_tombstone" if how.merged_flags else "not base_stub and not base_tombstone"
    fused = arrival.join(top, "query_id").join(base.where(shown), "node_key")
    fused = fused.select("query_id", "node_key", (LEXICAL * F.col("arrival") / F.col("top") + STRUCTURE * F.col("permille") / 1000).alias("score"), "seed")
    new = fresh_scores(of, nodes, n_base)
    new_top = new.groupBy("query_id").agg(F.max("score").alias("top"))
    new = new.join(new_top, "query_id").select("query_id", "node_key", (LEXICAL * F.col("score") / F.col("top")).alias("score"), F.lit(True).alias("seed"))
    order = W.partitionBy("query_id").orderBy(F.desc("seed"), F.desc(F.round("score", 9)), unsigned(F.col("node_key")))  # sums come in any order
    hits = fused.unionByName(new).withColumn("place", F.row_number().over(order)).where(F.col("place") <= how.limit)
    hits = written(hits, "hits")
    shown = hits.join((nodes if texts is None else texts).select(*TEXTS), "node_key").join(anchors(of, hits.select("query_id", "node_key"), segments), ["query_id", "node_key"], "left")
    shown = shown.withColumn("cost", token_cost(F.col("url"), F.col("title"), F.col("snippet"), F.col("anchor")))
    spent = F.sum("cost").over(W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return shown.withColumn("spent", spent).where(F.col("spent") <= how.budget).select("query_id", "place", "node_key", "url", "title", "snippet", "anchor", "score", "seed", "cost")
