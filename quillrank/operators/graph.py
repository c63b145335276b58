"""Similarity graphs as edge lists, spreading activation, typed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources.tables import cut, fresh_path, small

# Language names and chains of actions by which names are linked.
LANGUAGES = ("python", "go", "rust", "java", "kotlin", "swift", "dart", "react", "vue", "angular", "django", "fastapi", "spring", "flutter", "php", "cpp", "csharp", "typescript")
CHAINS = (
    (("contact", "通讯录", "联系人"), ("im", "消息", "发消息")),
    (("im", "消息", "发消息"), ("calendar", "日程", "会议")),
    (("scan", "扫描", "audit", "审计"), ("fix", "修复", "resolve")),
    (("build", "构建", "compile"), ("deploy", "部署", "release")),
    (("review", "审查", "code review"), ("refactor", "重构")),
    (("refactor", "重构", "clean"), ("test", "测试", "tdd")),
    (("search", "搜索", "find"), ("scrape", "parse", "extract")),
    (("plan", "规划", "architect"), ("build", "implement", "create")),
    (("ingest", "upload", "上传"), ("process", "convert", "处理")),
)


def neighbours_wanted(n: int) -> int:
    return min(8, max(3, int(n**0.5 / 3)))


def pair_cosines(vectors: DataFrame) -> DataFrame:
    """(src, dst, w) for all ordered pairs of long-form vectors (id, feature, w) that share a feature."""
    norm = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).withColumn("n", F.when(F.col("n") < 1e-10, 1.0).otherwise(F.col("n")))
    unit = vectors.join(norm, "id").select("id", "feature", (F.col("w") / F.col("n")).alias("u"))
    a, b = unit.select(F.col("id").alias("src"), "feature", F.col("u").alias("a")), unit.select(F.col("id").alias("dst"), "feature", F.col("u").alias("b"))
    return a.join(b, "feature").filter("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))


def dense_to_long(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.posexplode(vec_col).alias("feature", "x")).select("id", "feature", F.col("x").cast("double").alias("w"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each source, made symmetric by the larger weight."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    kept = pairs.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")
    both = kept.union(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def degree_normalise(edges: DataFrame) -> DataFrame:
    """w / sqrt(degree of src * degree of dst); degrees under 1e-10 count as 1."""
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")).withColumn("d", F.when(F.col("d") < 1e-10, 1.0).otherwise(F.col("d")))
    a, b = deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def density(edges: DataFrame, n: int, least: float = 0.01) -> DataFrame:
    """One row: share of all n * n cells with a weight over `least`."""
    return edges.agg((F.coalesce(F.sum((F.col("w") > least).cast("long")), F.lit(0)) / F.lit(float(max(n, 1)) ** 2)).alias("density"))


def spread(start: DataFrame, edges: DataFrame, steps: int = 3, decay: float = 0.5) -> DataFrame:
    """(query_id, id, score): activation handed along the edges; the factor of step s is decay^(s + 1) on top of the earlier ones, so it compounds. A total over 1 in the start is scaled to 1."""
    total = start.groupBy("query_id").agg(F.sum("score").alias("t"))
    now = start.join(total, "query_id").select("query_id", "id", (F.col("score") / F.greatest(F.col("t"), F.lit(1.0))).alias("score"))
    parts = [now]
    for s in range(steps):
        now = now.join(edges, now["id"] == edges["src"]).groupBy("query_id", F.col("dst").alias("id")).agg((F.sum(F.col("score") * F.col("w")) * decay ** (s + 1)).alias("score"))
        parts.append(now)
    return reduce(DataFrame.union, parts).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def spread_all(queries: DataFrame, start: DataFrame, items: DataFrame, n: int, edges: DataFrame, steps: int = 3, decay: float = 0.5) -> DataFrame:
    """spread() for all queries: one without activation (a total under 1e-10) starts with 1/n on each of the n items. That spread is the same for all such queries and is made once."""
    total = start.groupBy("query_id").agg(F.sum("score").alias("_t")).filter("_t >= 1e-10").select("query_id")
    blank = queries.select("query_id").distinct().join(total, "query_id", "left_anti")
    even = items.select(F.lit(0).alias("query_id"), "id", F.lit(1.0 / max(n, 1)).alias("score"))
    flat = spread(even, edges, steps, decay).select(F.lit(1).alias("_k"), "id", "score")
    made = blank.withColumn("_k", F.lit(1)).join(flat, "_k").select("query_id", "id", "score")
    return spread(start.join(total, "query_id", "left_semi"), edges, steps, decay).unionByName(made)


def typed_edges(items: DataFrame, name_col: str = "name", reverse_chains: bool = False, most_complements: int = 5) -> DataFrame:
    """(src, dst, type) by name rules: depends_on and complements.

    Each rule is an equi-join on (rule, side) of the names that show its keywords, never a join of all names with all.
    Of what complements a name only the first few names are kept, so each rule's other side is cut to these (and one more,
    the name itself) before the join. Depends edges are all wanted, so their number is that of the pairs a rule names.
    """
    names = items.select(F.col(name_col).alias("name")).filter("name is not null").distinct().withColumn("low", F.lower("name"))
    has = lambda *ks: reduce(lambda a, b: a | b, [F.contains("low", F.lit(k)) for k in ks])

    def sides(rules):
        return [names.select("name", F.explode(F.array_compact(F.array(*[F.when(r[s], F.lit(f"{k:03d}")) for k, r in enumerate(rules)]))).alias("rule")) for s in (0, 1)]

    def linked(rules, kind, most=None):
        a, b = sides(rules)
        if most is not None:
            first = F.row_number().over(Window.partitionBy("rule").orderBy("name"))
            b = b.withColumn("_p", first).filter(F.col("_p") <= most + 1).drop("_p")
        return a.select(F.col("name").alias("src"), "rule").join(b.select(F.col("name").alias("dst"), "rule"), "rule").filter("src <> dst").select("src", "dst").distinct().withColumn("type", F.lit(kind))

    chains = [(has(*down), has(*up)) if reverse_chains else (has(*up), has(*down)) for up, down in CHAINS]
    depends = linked([(has("auth"), has("auth")), (has("login", "认证"), has("auth")), *chains], "depends_on")
    alike = linked([*[(has(x), has(x)) for x in LANGUAGES], (has("review"), has("test")), (has("test"), has("review"))], "complements", most_complements)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return depends.union(alike.withColumn("_p", place).filter(F.col("_p") <= most_complements).drop("_p"))


def pull_dependencies(scored: DataFrame, depends: DataFrame, best: int = 10, least: float = 0.1, share: float = 0.7) -> DataFrame:
    """Scores in which each dependency (src, dst) of a query's best items has at least `share` of the item's score."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = scored.withColumn("_p", place).filter((F.col("_p") <= best) & (F.col("score") > least))
    given = top.join(depends, top["id"] == depends["src"]).groupBy("query_id", F.col("dst").alias("id")).agg((F.max("score") * share).alias("given"))
    return scored.join(given, ["query_id", "id"], "full_outer").select("query_id", "id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("given", F.lit(0.0))).alias("score"), F.col("given").isNotNull().alias("required"))


def typed_spread(start: DataFrame, complements: DataFrame, depends: DataFrame) -> DataFrame:
    """Spreading over complements, scaled to 0..1, dependencies pulled in, scaled again."""
    from quillrank.operators.vectors import normalise

    return normalise(pull_dependencies(normalise(spread(start, complements), by="query_id"), depends), by="query_id")


def weighted_complements(edges: DataFrame, items: DataFrame, tokens, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(src, dst, w) of complements edges: 0.3 + 0.7 of the items' token Jaccard; 0.5 if neither has tokens."""
    t = items.select(F.col(name_col).alias("name"), tokens(F.col(text_col)).alias("t"))
    joined = edges.join(t.select(F.col("name").alias("src"), F.col("t").alias("a")), "src").join(t.select(F.col("name").alias("dst"), F.col("t").alias("b")), "dst")
    either = F.size(F.array_union("a", "b"))
    return joined.select("src", "dst", F.when(either == 0, 0.5).otherwise(0.3 + 0.7 * F.size(F.array_intersect("a", "b")) / F.greatest(either, F.lit(1))).alias("w"))


def nearest_dense(rows: DataFrame, k: int, id_col: str, vec_col: str, digits: int = 9, block: int = 4096, least: float | None = None) -> DataFrame:
    """(src, dst, w): the k best cosines of each dense vector (null vectors take no part; least: only weights over it).

    Sources are dealt into blocks of about `block` rows by a hash and written. Block after block is broadcast
    to all vectors; a task looks at some hundred of these at a time and keeps the best. Results are written block by block.
    """
    import numpy as np
    import pandas as pd

    spark = rows.sparkSession
    held = rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = -(-held.count() // block)
    sources = cut(held.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))).repartition("b"))
    path = fresh_path(spark)
    shape = "src long, dst long, w double"
    spark.createDataFrame([], shape).write.parquet(path)

    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)

    for n in range(blocks):
        part = sources.filter(F.col("b") == n).select("id", "v").toArrow()  # about `block` rows
        if not part.num_rows:
            continue
        ids = part.column("id").to_numpy()
        vectors = unit(np.array(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1))
        shared = spark.sparkContext.broadcast((ids, vectors))

        def run(batches, shared=shared):
            ids, x = shared.value
            best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                for s in range(0, len(b), 512):
                    cand, y = b["id"].to_numpy()[s : s + 512], unit(np.array(b["v"].iloc[s : s + 512].tolist()))
                    w = np.round(x @ y.T, digits)
                    w[cand[None, :] == ids[:, None]] = -np.inf
                    bound = best[:, -1]
                    if w.shape[1] > k:
                        bound = np.maximum(bound, np.partition(w, -k, axis=1)[:, -k])
                    r, c = np.nonzero((w >= bound[:, None]) & np.isfinite(w))
                    some = np.unique(r)
                    row = np.concatenate([np.repeat(some, k), r])
                    value = np.concatenate([best[some].ravel(), w[r, c]])
                    name = np.concatenate([who[some].ravel(), cand[c]])
                    order = np.lexsort((name, -value, row))
                    row = row[order]
                    take = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                    best[some], who[some] = value[take].reshape(-1, k), name[take].reshape(-1, k)
            i, j = np.nonzero(np.isfinite(best) & (best > (-np.inf if least is None else least)))
            yield pd.DataFrame({"src": ids[i], "dst": who[i, j], "w": best[i, j]})

        place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
        held.mapInPandas(run, shape).withColumn("_p", place).filter(F.col("_p") <= k).drop("_p").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(shape).parquet(path)


def feature_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """The k best cosines over 0 of each item of long-form vectors (id, feature, w), as (src, dst, w), made symmetric.

    Features are few (a lexicon's) and some are on most items, so joining items on them would pair all with all; items become dense rows instead.
    """
    names = [r["feature"] for r in vectors.select("feature").distinct().orderBy("feature").collect()]  # a lexicon's features
    place = F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(i))]) if names else None
    if place is None:
        return vectors.sparkSession.createDataFrame([], "src long, dst long, w double")
    held = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(place[F.col("feature")].alias("i"), "w"))).alias("m"))
    dense = held.select("id", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))
    return symmetric(nearest_dense(dense, k, "id", "v", digits=12, least=0.0))


def resolve_names(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """(wanted, id, name): the item of that name, else the first one, by id, whose name holds it without regard to case. wanted: a column `wanted`, few rows; the rest have no row."""
    asked = wanted.select("wanted").filter("wanted is not null and wanted <> ''").distinct()
    names = items.select("id", "name").filter("name is not null")
    exact = asked.join(names, asked["wanted"] == names["name"]).groupBy("wanted").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id"))
    open_ = asked.join(exact, "wanted", "left_anti")
    near = names.join(small(open_), F.contains(F.lower("name"), F.lower("wanted"))).groupBy("wanted").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id"))
    return exact.unionByName(near).select("wanted", "id", "name")


def declared_edges(items: DataFrame, tokens=None, text_col: str = "text") -> DataFrame:
    """(src, dst, type, w) of what items (id, name, requires, complements) declare: names resolved, an item never with itself; depends_on weighs 1, complements by token overlap if tokens is given, else 1."""
    rows = [items.select(F.col("name").alias("src"), F.explode(c).alias("wanted"), F.lit(kind).alias("type")) for c, kind in (("requires", "depends_on"), ("complements", "complements"))]
    said = rows[0].union(rows[1])
    edges = said.join(resolve_names(said.select("wanted"), items), "wanted").select("src", F.col("name").alias("dst"), "type").filter("src <> dst").distinct()
    if tokens is None:
        return edges.withColumn("w", F.lit(1.0))
    alike = weighted_complements(edges.filter("type = 'complements'").select("src", "dst"), items, tokens, text_col=text_col)
    return edges.filter("type = 'depends_on'").withColumn("w", F.lit(1.0)).unionByName(alike.select("src", "dst", F.lit("complements").alias("type"), "w"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(type, edges) of typed edges."""
    return edges.groupBy("type").agg(F.count("*").alias("edges"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
