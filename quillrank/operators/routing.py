"""Rules, triggers, fuzzy correction, and the layered pipeline over a set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import bm25
from quillrank.sources.tables import cut, small


def rule_matches(queries: DataFrame, rules: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(query_id, skill): first rule (pos, pattern, skill), in order, whose pattern is in the query without regard to case and whose skill exists."""
    live = rules if items is None else rules.join(items.select(F.col("name").alias("skill")).distinct(), "skill", "left_semi")
    hit = queries.join(small(live), F.expr("query rlike concat('(?i)', pattern)"))
    return hit.groupBy("query_id").agg(F.min_by("skill", "pos").alias("skill"))


def with_rules(ranked: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, rank, name, score) with the rule's skill first at score 1, the others after it without repetition, k in all."""
    first = matches.select("query_id", F.lit(0).alias("rank"), F.col("skill").alias("name"), F.lit(1.0).alias("score"))
    rest = ranked.select("query_id", "rank", "name", "score").join(first.select("query_id", "name"), ["query_id", "name"], "left_anti").select("query_id", "rank", "name", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.unionByName(rest).withColumn("rank", place).filter(F.col("rank") <= k)


def trigger_matches(queries: DataFrame, triggers: DataFrame) -> DataFrame:
    """(query_id, skill): the phrase (phrase, skill, ord) that is the query, else the longest one in it; ties to the earlier."""
    held = triggers.withColumn("phrase", F.lower(F.trim("phrase"))).groupBy("phrase").agg(F.max_by("skill", "ord").alias("skill"), F.min("ord").alias("ord"))
    asked = queries.select("query_id", F.lower(F.trim(F.coalesce("query", F.lit("")))).alias("q"))
    hit = asked.join(small(held.filter("phrase <> ''")), F.contains("q", "phrase"))
    best = F.struct((F.col("q") == F.col("phrase")).alias("same"), F.length("phrase").alias("n"), (-F.col("ord")).alias("o"))
    return hit.groupBy("query_id").agg(F.max_by("skill", best).alias("skill"))


def corrections(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, term, dist): nearest known term of at most `most` edits of each unknown word; ties to the term that sorts first.

    Words and terms meet on shared deletion variants, so no word is compared with the whole vocabulary.
    """
    known = vocabulary.select("term").filter("term is not null").distinct()
    # A word longer than every term by more than the bound has no near one; variants grow with the square of the length.
    longest = known.agg(F.coalesce(F.max(F.length("term")), F.lit(-1 - most)).alias("_l"))
    asked = words.select("word").distinct().join(F.broadcast(longest), F.length("word") <= F.col("_l") + most).select("word")
    asked = asked.join(known.select(F.col("term").alias("word")), "word", "left_anti")

    def variants(df, col):
        less = lambda a: F.flatten(F.transform(a, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        found, level = F.array(F.col(col)), F.array(F.col(col))
        for _ in range(most):
            level = F.array_distinct(less(level))
            found = F.concat(found, level)
        return df.select(col, F.explode(F.array_distinct(found)).alias("v"))

    near = variants(asked, "word").join(variants(known, "term"), "v").select("word", "term").distinct()
    near = near.withColumn("dist", F.levenshtein("word", "term", most)).filter("dist >= 0")
    return near.groupBy("word").agg(F.min_by("term", F.struct("dist", "term")).alias("term"), F.min("dist").alias("dist"))


def fuzzy_queries(queries: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, query) of queries in which an unknown word has a near term, all such words replaced wherever they stand."""
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    found = words.join(corrections(words, vocabulary, most), "word").groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("word", "term"))).alias("pairs"))
    return found.select("query_id", F.aggregate("pairs", F.lower("query"), lambda q, p: F.replace(q, p["word"], p["term"])).alias("query"))


def layers(queries: DataFrame, items: DataFrame, triggers: DataFrame, rules: DataFrame, vocabulary: DataFrame, k: int = 3, terms: list[str] = ()) -> DataFrame:
    """(query_id, layer, rank, name, score): each query is answered by the first of gate, trigger, rule, keyword, fuzzy that has something; else layer 'none'.

    items: id, name, text. The gate's queries have no answer either, layer 'skip'.
    """
    shape = ["query_id", "layer", "rank", "name", "score"]
    blank = lambda df, layer: df.select("query_id", F.lit(layer).alias("layer"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("score"))
    one = lambda df, layer: df.select("query_id", F.lit(layer).alias("layer"), F.lit(1).alias("rank"), F.col("skill").alias("name"), F.lit(1.0).alias("score"))
    open_ = cut(queries.filter(X.is_task(F.col("query"))))
    out = blank(queries.join(open_.select("query_id"), "query_id", "left_anti"), "skip")
    for layer, found in (("trigger", trigger_matches), ("rule", rule_matches)):
        hit = cut(found(open_, triggers if layer == "trigger" else rules))
        out, open_ = out.unionByName(one(hit, layer)), cut(open_.join(hit.select("query_id"), "query_id", "left_anti"))

    def keyword(asked, layer):
        found = bm25.boosted_from(asked, corpus, terms)
        top = bm25.top_k(found, k, 6).join(items.select("id", "name"), "id")
        return cut(top.select("query_id", F.lit(layer).alias("layer"), "rank", "name", "score"))

    corpus = bm25.boosted_index(items, F.col("name"), F.concat_ws(" ", "name", "text"), terms)
    hit = keyword(open_, "keyword")
    out, open_ = out.unionByName(hit), cut(open_.join(hit.select("query_id").distinct(), "query_id", "left_anti"))
    hit = keyword(fuzzy_queries(open_, vocabulary), "fuzzy")
    out, open_ = out.unionByName(hit), open_.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return out.unionByName(blank(open_, "none")).select(*shape)
