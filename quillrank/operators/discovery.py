"""Feature discovery: candidate terms, co-occurrence, greedy clusters, tiers, quality report."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions import lexicon as L
from quillrank.functions import text as X
from quillrank.sources.tables import cut

# Bounds of the document frequency, sizes of clusters.
MOST_SHARE, LEAST_SHARE, LEAST_DF, TERMS, CLUSTERS, NEIGHBOURS, TERMS_KEPT = 0.75, 0.015, 3, 200, 28, 10, 12


def candidate_terms(items: DataFrame, stop_words: list[str] = (), most: int = TERMS, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(term, df, weight): terms in the frequency band, by smoothed idf with a bonus for compounds; the `most` best, ties by term."""
    n = items.count()
    df = items.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(X.discovery_tokens(F.col(text_col), list(stop_words)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= max(LEAST_DF, int(LEAST_SHARE * n))) & (F.col("df") / max(n, 1) <= MOST_SHARE))
    parts = F.size(F.split("term", "[-/]"))
    weight = (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1) * (1 + 0.3 * (parts - 1))
    return band.select("term", "df", F.round(weight, 9).alias("weight")).orderBy(F.desc("weight"), "term").limit(most)


def cooccurrence(items: DataFrame, terms: DataFrame, stop_words: list[str] = (), text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(a, b, share): co-occurrence over position pairs of the documents' term bags, divided by the sum of a's row. A term that a document repeats m times counts m(m-1) with itself."""
    bags = items.select(F.col(id_col).alias("id"), F.explode(X.discovery_tokens(F.col(text_col), list(stop_words))).alias("term")).join(F.broadcast(terms.select("term")), "term").groupBy("id", "term").agg(F.count("*").alias("m"))
    a, b = bags.select("id", F.col("term").alias("a"), F.col("m").alias("x")), bags.select("id", F.col("term").alias("b"), F.col("m").alias("y"))
    both = a.join(b, "id").groupBy("a", "b").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("x") * (F.col("x") - 1)).otherwise(F.col("x") * F.col("y"))).alias("c"))
    total = both.groupBy("a").agg(F.sum("c").alias("t"))
    return both.join(total, "a").filter("c > 0").select("a", "b", (F.col("c") / F.col("t")).alias("share"))


def clusters(terms: DataFrame, shares: DataFrame, n_items: int) -> dict[str, list[str]]:
    """Feature name -> terms. Seeds go by falling weight; each takes its ten closest free terms over the threshold. All terms come to the driver: candidate_terms bounds their number."""
    bound = 0.06 if n_items < 100 else 0.08 if n_items < 300 else 0.10
    least = 1 if n_items < 100 else 2
    order = [r["term"] for r in terms.orderBy(F.desc("weight"), "term").collect()]
    near: dict[str, list] = {}
    for r in shares.filter((F.col("share") > bound) & (F.col("a") != F.col("b"))).collect():
        near.setdefault(r["a"], []).append((-r["share"], r["b"]))
    taken, out = set(), {}
    for seed in order:
        if len(out) >= min(CLUSTERS, len(order) // 2):
            break
        free = sorted(x for x in near.get(seed, []) if x[1] not in taken)[:NEIGHBOURS]
        if seed in taken or len(free) < least:
            continue
        members = [seed, *[t for _, t in free]]
        taken.update(members)
        clean = [t for t in members if len(t) >= 3 or re.search("[一-鿿]", t)]
        if len(clean) >= 2:
            key = re.sub("[^a-z0-9_]", "_", seed.lower())[:30].strip("_")
            out[key if len(key) >= 3 else f"cluster_{len(out)}"] = clean[:TERMS_KEPT]
    return out


def coverage(items: DataFrame, found: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """(feature, covered, share) of items that hold any of a feature's terms."""
    n = items.count()
    flags = [F.sum(L._hit(F.lower(F.col(text_col)), ks).cast("long")).alias(f"f{i}") for i, (_, ks) in enumerate(sorted(found.items()))]
    names = sorted(found)
    if not names:
        return items.sparkSession.createDataFrame([], "feature string, covered long, share double")
    row = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("covered")) for i, f in enumerate(names)])
    return items.agg(*flags).select(F.explode(row).alias("r")).select("r.feature", "r.covered", (F.col("r.covered") / F.lit(float(max(n, 1)))).alias("share"))


def split_tiers(items: DataFrame, found: dict[str, list[str]], n_broad: int = 14, text_col: str = "text") -> L.Lexicon:
    """The most widespread features, 14 at most and over a bound that falls with the corpus, are broad, the rest precise."""
    n = items.count()
    bound = min(0.15, max(0.08, 2 / max(n, 10)))
    rows = sorted(((-r["share"], r["feature"]) for r in coverage(items, found, text_col).collect()))
    broad = [f for s, f in rows if -s >= bound][:n_broad]
    return {"broad": {f: found[f] for f in broad}, "precise": {f: ks for f, ks in found.items() if f not in broad}}


def discover(items: DataFrame, stop_words: list[str] = (), text_col: str = "text", id_col: str = "id") -> L.Lexicon:
    terms = cut(candidate_terms(items, stop_words, text_col=text_col, id_col=id_col))
    return split_tiers(items, clusters(terms, cooccurrence(items, terms, stop_words, text_col, id_col), items.count()), text_col=text_col)


def quality_report(items: DataFrame, features: DataFrame) -> DataFrame:
    """One row: coverage, empty items, mean features, features, features on over 80 % of the items among the ten most frequent, largest group of items with one feature set, score of 100."""
    names = features.select("id", "feature").distinct()
    per = items.select("id").join(names.groupBy("id").agg(F.array_sort(F.collect_set("feature")).alias("fs")), "id", "left")
    whole = per.agg(F.count("*").alias("items"), F.sum(F.col("fs").isNull().cast("long")).alias("empty"), F.avg(F.coalesce(F.size("fs"), F.lit(0))).alias("mean_features"))
    groups = per.filter("fs is not null").groupBy("fs").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest_group"))
    df = names.groupBy("feature").agg(F.count("*").alias("df"))
    count, top = df.agg(F.count("*").alias("features")), df.orderBy(F.desc("df"), "feature").limit(10)
    row = whole.join(groups).join(count).first()  # one row each
    n = max(row["items"] or 0, 1)
    wide = top.filter(F.col("df") / n > 0.8).count()
    cov = 1 - (row["empty"] or 0) / n
    score = round(40 * cov + 30 * min(1, (row["features"] or 0) / 60) + max(0, 30 - wide))
    return items.sparkSession.createDataFrame([(cov, row["empty"] or 0, row["mean_features"] or 0.0, row["features"], wide, row["largest_group"], int(score))], "coverage double, empty long, mean_features double, features long, wide long, largest_group long, score long")


def item_keywords(items: DataFrame, most: int = 8, stop_words: list[str] = (), text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, keywords): longest terms of each item, compounds half as much again; ties by term."""
    scored = F.transform(F.array_distinct(X.discovery_tokens(F.col(text_col), list(stop_words))), lambda t: F.struct((-F.length(t) * F.when(t.rlike("[-/_]"), 1.5).otherwise(1.0)).alias("s"), t.alias("t")))
    return items.select(F.col(id_col).alias("id"), F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["t"]).alias("keywords"))


def broad_category(keywords: list[str], lexicon: L.Lexicon) -> str | None:
    """The broad feature that most keywords fit (one holds the other, either way); two at least, ties to the first feature."""
    best, most = None, 1
    low = [k.lower() for k in keywords]
    for feature, ks in lexicon.get("broad", {}).items():
        n = sum(any(k in c.lower() or c.lower() in k for c in ks) for k in low if k)
        if n > most:
            best, most = feature, n
    return best


def extract_items(items: DataFrame, lexicon: L.Lexicon, most: int = 8, stop_words: list[str] = (), text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, key, keywords, broad): each item's longest terms, the feature key made of the first, and the broad feature they fit (null: none)."""
    held = item_keywords(items, most, stop_words, text_col, id_col)
    key = X.slug(F.coalesce(F.try_element_at("keywords", F.lit(1)), F.lit("")))
    fit = lambda w, c: F.contains(w, F.lit(c.lower())) | F.contains(F.lit(c.lower()), w)
    names = list(lexicon.get("broad", {}).items())
    fitting = lambda ks: F.size(F.filter("keywords", lambda w: reduce(lambda a, b: a | b, [fit(w, c) for c in ks], F.lit(False))))
    counts = [fitting(ks) for _, ks in names]
    rank = [F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(f).alias("f")) for i, ((f, _), n) in enumerate(zip(names, counts))]
    best = F.array_max(F.array(*rank)) if rank else F.lit(None).cast("struct<n:int,o:int,f:string>")
    return held.select("id", F.when(F.length(key) > 0, key).otherwise(F.concat(F.lit("feat_"), F.col("id").cast("string"))).alias("key"), "keywords", F.when(best["n"] >= 2, best["f"]).alias("broad"))


def discover_report(items: DataFrame, base: L.Lexicon, stop_words: list[str] = (), text_col: str = "text", id_col: str = "id") -> tuple[L.Lexicon, dict]:
    """(merged lexicon, report): features are discovered, merged into the base, and the items' coverage by the result is judged."""
    found = discover(items, stop_words, text_col, id_col)
    merged = L.merge_discovered(base, found)
    rows = L.long_features(items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), merged)
    row = quality_report(items.select(F.col(id_col).alias("id")), cut(rows)).first().asDict()
    count = lambda lex: {t: len(lex.get(t, {})) for t in L.TIERS}
    return merged, row | {"discovered": count(found), "merged": count(merged), "recommendation": recommendation(row["score"])}


def recommendation(score: int) -> str:
    return "good" if score >= 80 else "usable" if score >= 50 else "poor"


def band(n: int) -> tuple[int, float]:
    return max(LEAST_DF, math.floor(LEAST_SHARE * n)), MOST_SHARE
