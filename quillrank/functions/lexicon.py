"""Lexicons: features with keywords, matched as substrings, in two tiers.

A lexicon is data: rows (tier 'broad' or 'precise', feature, keyword). A keyword that starts with
\\b is a regular expression, any other is matched as a substring with its blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import CJK

# Language short names that count when CJK text follows at once.
MIXED_LANGUAGES = (
    ("go", "go"),
    ("c++", "cpp"),
    ("c#", "csharp"),
    ("cs", "csharp"),
    ("ts", "javascript_ts"),
    ("js", "javascript_ts"),
    ("rs", "rust"),
    ("kt", "kotlin"),
    ("rb", "ruby"),
)
#: Keywords compiled into one set of column expressions; a larger lexicon takes several, one after another.
COMPILED = 2000

TIERS = ("broad", "precise")
Lexicon = dict[str, dict[str, list[str]]]


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """A JSON file {tier: {feature: [keyword, ...]}}."""
    import json

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    held = json.loads(text)
    return {tier: {f: list(ks) for f, ks in held.get(tier, {}).items()} for tier in ("broad", "precise")}


def sample_lexicon() -> Lexicon:
    """A small lexicon of our own for software items, to start with; a corpus deserves one of its own (read_lexicon)."""
    broad = {
        "security": ["security", "vulnerab", "安全"], "testing": ["test", "测试"], "frontend": ["frontend", "react", "css", "前端"], "backend": ["backend", "server", "api", "后端"],
        "database": ["database", "sql", "数据库"], "devops": ["deploy", "docker", "kubernetes", "部署"], "data": ["dataset", "pipeline", "数据"], "ml": ["machine learning", "training", "模型"],
        "document": ["document", "markdown", "文档"], "mobile": ["mobile", "android", "ios"], "network": ["network", "proxy", "网络"], "code_quality": ["review", "lint", "审查"],
    }
    precise = {
        "python": ["python", "pytest"], "javascript_ts": ["javascript", "typescript", "node"], "go": ["\\bgo\\b", "golang"], "rust": ["rust", "cargo"], "java": ["java ", "spring"],
        "shell": ["bash", "shell"], "build_fix": ["build error", "compile", "构建"], "performance": ["performance", "latency", "性能"], "planning": ["plan", "roadmap", "规划"], "refactor_clean": ["refactor", "dead code", "重构"],
    }
    return {"broad": broad, "precise": precise}


def merge(base: Lexicon, *packs: Lexicon) -> Lexicon:
    """Later packs replace whole features of earlier ones."""
    return {tier: reduce(lambda a, b: a | b, [p.get(tier, {}) for p in (base, *packs)]) for tier in ("broad", "precise")}


def merge_discovered(base: Lexicon, found: Lexicon, user: Lexicon | None = None) -> Lexicon:
    """base with discovered features of novel terms: three new terms of three letters or more at least, ten (broad) or eight kept; none if under 30 % of the terms, or under ten, are distinct. The user's features replace whole features."""
    terms = [t for fs in found.values() for ks in fs.values() for t in ks]
    out = {tier: dict(base.get(tier, {})) for tier in ("broad", "precise")}
    if len(set(terms)) >= 10 and len(set(terms)) >= 0.3 * len(terms):
        known = {k.lower() for fs in base.values() for ks in fs.values() for k in ks}
        for tier, most in (("broad", 10), ("precise", 8)):
            for feature, ks in found.get(tier, {}).items():
                novel = [k for k in ks if k.lower() not in known and len(k) >= 3]
                if feature not in out[tier] and len(novel) >= 3:
                    out[tier][feature] = novel[:most]
    return merge(out, user or {})


def _hit(text: Column, keywords: list[str]) -> Column:
    tests = [text.rlike(k.lower()) if k.startswith("\\b") else F.contains(text, F.lit(k.lower())) for k in keywords]
    return reduce(lambda a, b: a | b, tests)


def _shown(low: Column, lexicon: Lexicon, mixed: bool) -> Column:
    """array<struct<tier,feature>> of the features that a lower-case text shows."""
    pair = lambda t, f: F.struct(F.lit(t).alias("tier"), F.lit(f).alias("feature"))
    found = [F.when(_hit(low, ks), pair(t, f)) for t in TIERS for f, ks in sorted(lexicon.get(t, {}).items()) if ks]
    none = F.array().cast("array<struct<tier:string,feature:string>>")
    out = F.array_compact(F.array(*found)) if found else none
    if mixed:
        # Only texts with CJK characters are looked through for language names.
        names = F.array_compact(F.array(*[F.when(low.rlike("(?<![a-z])" + "".join("\\" + c if not c.isalnum() else c for c in short) + CJK), F.lit(name)) for short, name in MIXED_LANGUAGES]))
        in_tier = lambda t: F.transform(names, lambda n: F.struct(F.lit(t).alias("tier"), n.alias("feature")))
        both = F.concat(*[in_tier(t) for t in TIERS])
        out = F.concat(out, F.when(low.rlike(CJK), both).otherwise(none))
    return F.array_distinct(out)


def features(text: Column, lexicon: Lexicon) -> Column:
    """array<struct<tier,feature>> of the features that a text shows. Mixed-script language names count in both tiers."""
    return _shown(F.lower(F.coalesce(text, F.lit(""))), lexicon, True)


def parts(lexicon: Lexicon, most: int | None = None) -> list[Lexicon]:
    """The lexicon in parts of about `most` keywords; a feature stays whole."""
    out, held = [{t: {} for t in TIERS}], 0
    for tier in TIERS:
        for f, ks in sorted(lexicon.get(tier, {}).items()):
            if held and held + len(ks) > (most or COMPILED):
                out.append({t: {} for t in TIERS})
                held = 0
            out[-1][tier][f] = ks
            held += len(ks)
    return out


def long_features(items: DataFrame, lexicon: Lexicon, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, tier, feature) rows. Texts are lower-cased once; a large lexicon goes over them in parts."""
    low = items.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    made = [low.select("id", F.explode(_shown(F.col("low"), p, k == 0)).alias("f")).select("id", "f.tier", "f.feature") for k, p in enumerate(parts(lexicon))]
    out = reduce(DataFrame.union, made)
    return out if len(made) == 1 else out.distinct()  # a lexicon may name a language as a feature too
