"""Order of selected items by what they provide and need."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capabilities(items: DataFrame) -> DataFrame:
    """(name, provides, needs): provides else outputs, needs else inputs, lower case."""
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
    col = lambda n: F.col(n) if n in items.columns else F.lit(None).cast("array<string>")
    return items.select("name", low(F.coalesce(col("provides"), col("outputs"))).alias("provides"), low(F.coalesce(col("needs"), col("inputs"))).alias("needs"))


def dependency_edges(chosen: DataFrame, items: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(query_id, src, dst): dst needs what src provides, or depends on src explicitly (explicit: src depends on dst); both among the query's items."""
    caps = chosen.select("query_id", "name").distinct().join(capabilities(items), "name")
    have, want = caps.select("query_id", F.col("name").alias("src"), F.explode("provides").alias("c")), caps.select("query_id", F.col("name").alias("dst"), F.explode("needs").alias("c"))
    edges = have.join(want, ["query_id", "c"]).filter("src <> dst").select("query_id", "src", "dst")
    if explicit is not None:
        mine = chosen.select("query_id", "name").distinct()
        e = explicit.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(mine.withColumnRenamed("name", "src"), "src").join(mine.withColumnRenamed("name", "dst"), ["query_id", "dst"])
        edges = edges.union(e.select("query_id", "src", "dst"))
    return edges.distinct()


def order_one(names: list[str], scores: dict[str, float], edges: list[tuple[str, str]], linked: bool) -> tuple[list[str], list[str]]:
    """(steps, unresolved): of the items that wait for nothing the best-scoring one comes next (ties by name); a cycle's items stay unresolved. Without links the order given."""
    if not linked:
        return names, []
    waits, after = {n: 0 for n in names}, {n: [] for n in names}
    for a, b in edges:
        waits[b] += 1
        after[a].append(b)
    heap = [(-scores[n], n) for n in names if not waits[n]]
    heapq.heapify(heap)
    steps = []
    while heap:
        _, n = heapq.heappop(heap)
        steps.append(n)
        for m in after[n]:
            waits[m] -= 1
            if not waits[m]:
                heapq.heappush(heap, (-scores[m], m))
    return steps, [n for n in names if n not in set(steps)]


def plan(chosen: DataFrame, items: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, name, resolved) of chosen (query_id, rank, name, score); one query's items, the k best, are one small group."""
    edges = dependency_edges(chosen, items, explicit).groupBy("query_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    caps = chosen.select("query_id", "name").join(capabilities(items), "name").groupBy("query_id").agg(F.max((F.size("provides") + F.size("needs") > 0)).alias("any"))
    rows = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "score"))).alias("items")).join(edges, "query_id", "left").join(caps, "query_id", "left")

    given = explicit is not None

    def run(batches):
        for b in batches:
            out = []
            for q, held, links, any_ in zip(b["query_id"], b["items"], b["edges"], b["any"]):
                scores = {x["name"]: x["score"] for x in held}
                names = list(dict.fromkeys(x["name"] for x in held))
                steps, left = order_one(names, scores, [(e["src"], e["dst"]) for e in links] if links is not None else [], bool(any_) or given)
                out += [(q, i + 1, n, True) for i, n in enumerate(steps)] + [(q, len(steps) + i + 1, n, False) for i, n in enumerate(left)]
            yield pd.DataFrame(out, columns=["query_id", "pos", "name", "resolved"])

    kind = chosen.schema["query_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"query_id {kind}, pos long, name string, resolved boolean")


def to_prompt(planned: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered steps, then what could not be ordered."""
    line = F.when(F.col("resolved"), F.format_string("%d. %s", F.col("pos"), F.col("name"))).otherwise(F.format_string("- %s (unresolved)", F.col("name")))
    return planned.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
