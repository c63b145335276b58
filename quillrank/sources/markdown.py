"""Items from Markdown files with YAML front matter, and the small stores beside them."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What opens a section of triggers, and suffixes of source files.
TRIGGER_LINE = "(?i)(trigger|触发|when to use|use when|use this)"
SOURCE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "kt", "rb", "php", "cs")
LEAST_CHARS, BODY_CHARS = 20, 500


def directories_of(setting: str | None, defaults: list[str] = ()) -> list[str]:
    """Folders named by a setting, parted by colons (an environment variable's value, say); without one the defaults. Repeated and empty ones go."""
    named = [d.strip() for d in (setting or "").split(":") if d.strip()]
    return list(dict.fromkeys(named or list(defaults)))


def whole_files(spark: SparkSession, directories: list[str], pattern: str = "*.md", modified_after: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, dir_pos, value): files below the directories, or right in them and their own folders; a file under several counts for the first. Folders that don't exist have no files."""
    parts = []
    for pos, d in enumerate(directories):
        if not exists(spark, d):
            continue
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
        if not recursive:
            d = [x for x in (d, *folders(spark, d))]
        if modified_after:
            reader = reader.option("modifiedAfter", modified_after)
        parts.append(reader.text(d, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(pos).alias("dir_pos"), "value"))
    if not parts:
        return spark.createDataFrame([], "path string, dir_pos int, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def only_item_files(files: DataFrame) -> DataFrame:
    """Without the other files of a directory that has a SKILL.md of its own."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    named = F.lower(F.regexp_extract("path", "[^/]*$", 0)) == "skill.md"
    files = files.withColumn("_dir", folder).withColumn("_own", named)
    own = files.filter("_own").select("_dir").distinct().withColumn("_has", F.lit(True))
    return files.join(own, "_dir", "left").filter("_own or _has is null").drop("_dir", "_own", "_has")


def _yaml(text: str) -> dict:
    try:
        import yaml

        held = yaml.safe_load(text)
    except ImportError:  # without the library: flat `key: value` lines and bracket lists
        held = {}
        for line in text.splitlines():
            key, colon, value = line.partition(":")
            if colon and not key.startswith((" ", "-", "#")):
                value = value.strip().strip("\"'")
                held[key.strip()] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value
    except Exception:
        held = {}
    return held if isinstance(held, dict) else {}


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _hadoop(spark, path)
    return files.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right in a folder."""
    p, files = _hadoop(spark, path)
    return sorted(x.getPath().toString() for x in files.listStatus(p) if x.isDirectory())


META = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("requires", "complements", "provides", "needs")])


@F.pandas_udf(META)
def front_matter(text: pd.Series) -> pd.DataFrame:
    """Fields of a YAML block; anything malformed gives nulls. Lists hold strings or mappings with a name."""

    def names(x):
        x = [] if x is None else x if isinstance(x, list) else [x]
        return [str(i.get("name", "")) if isinstance(i, dict) else str(i) for i in x]

    rows = []
    for t in text:
        m = _yaml(t or "")
        word = lambda k, m=m: None if m.get(k) is None else str(m[k])
        rows.append((word("name"), word("description"), names(m.get("requires", m.get("depends_on"))), names(m.get("complements")), names(m.get("provides", m.get("outputs"))), names(m.get("needs", m.get("inputs")))))
    return pd.DataFrame(rows, columns=["name", "description", "requires", "complements", "provides", "needs"])


def trigger_text(body: Column) -> Column:
    """Bullets of the sections that speak of triggers, else all second-level headings, joined by blanks. A fold over the lines: a line of a word character closes a section."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("got"))

    def line(s, x):
        opens, bullet, word = x.rlike(TRIGGER_LINE), x.rlike(r"^\s*[-*]"), x.rlike(r"^\w")
        now = F.when(opens, True).when(word, False).otherwise(s["open"])
        got = F.when(s["open"] & bullet & ~opens, F.array_append(s["got"], F.trim(F.regexp_replace(x, r"^\s*[-*]+\s*", "")))).otherwise(s["got"])
        return F.struct(now.alias("open"), got.alias("got"))

    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    bullets = F.aggregate(lines, start, line, lambda s: s["got"])
    headings = F.transform(F.filter(lines, lambda x: x.rlike(r"^##\s+")), lambda x: F.trim(F.regexp_replace(x, r"^##\s+", "")))
    return F.array_join(F.when(F.size(bullets) > 0, bullets).otherwise(headings), " ")


def parse_items(files: DataFrame) -> DataFrame:
    """name, description, search_text, source, body, meta, path of files of twenty characters or more."""
    text = F.trim("value")
    split = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(split) >= 3)
    body = F.when(has, F.trim(F.element_at(split, 3))).otherwise(text)
    held = files.filter(F.length(text) >= LEAST_CHARS).withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", "")).withColumn("meta", front_matter(F.when(has, F.element_at(split, 2)).otherwise("")))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    name, description = F.coalesce("meta.name", stem), F.coalesce("meta.description", F.lit(""))
    search = F.lower(F.concat_ws(" ", name, description, trigger_text(F.col("body"))))
    return held.select(name.alias("name"), description.alias("description"), search.alias("search_text"), F.when(F.col("path").contains("agents"), "agent").otherwise("skill").alias("source"), "body", "meta", "path", "dir_pos")


def first_of_each(items: DataFrame) -> DataFrame:
    """One item a name: the first directory's, then the first path's."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("dir_pos", "path"))
    return items.withColumn("_p", place).filter("_p = 1").drop("_p")


def with_ids(items: DataFrame) -> DataFrame:
    """items with id: place by (dir_pos, path), numbered in range partitions."""
    from quillrank.operators.fusion import places

    key = items.withColumn("_k", F.concat_ws("\u0001", F.format_string("%06d", "dir_pos"), "path"))
    pos, _ = places(key, "_k")
    return key.join(pos.withColumnRenamed("id", "_k").withColumnRenamed("pos", "id"), "_k").drop("_k")


def load_items(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Items of all directories, one a name, with ids."""
    return with_ids(first_of_each(parse_items(only_item_files(whole_files(spark, directories)))))


def load_plugin_items(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Items of SKILL.md files alone, right in the directories or in their own folders; the search text holds the body's first 500 characters."""
    items = parse_items(whole_files(spark, directories, "SKILL.md", recursive=False))
    return items.withColumn("search_text", F.lower(F.concat_ws(" ", "name", "description", F.substring("body", 1, BODY_CHARS))))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(value) of one file; no row if there is none."""
    return spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(pos, pattern, skill) of a JSON list, in its order; none if the file is missing or broken."""
    text = whole_text(spark, path).select(F.from_json("value", "array<struct<pattern:string,skill:string>>").alias("r"))
    return text.select(F.posexplode("r").alias("pos", "x")).select("pos", "x.pattern", "x.skill")


def load_triggers(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, skill, ord) of a JSON object {skill: [phrases]}."""
    text = whole_text(spark, path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = text.select(F.posexplode(F.map_entries("m")).alias("i", "e")).select("i", "e.key", F.posexplode("e.value").alias("j", "phrase"))
    return rows.select(F.lower(F.trim("phrase")).alias("phrase"), F.col("key").alias("skill"), (F.col("i") * 1000000 + F.col("j")).cast("long").alias("ord"))


def load_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected) of a JSON list; none if the file is missing or broken."""
    text = whole_text(spark, path).select(F.from_json("value", "array<struct<query:string,expected:array<string>>>").alias("r"))
    return text.select(F.posexplode("r").alias("query_id", "x")).select("query_id", "x.query", "x.expected")


def load_notes(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(path, domain, date, tags, summary, body): naive `key: value` heads; the summary is the first line that is no heading or quote, cut to 200."""
    files = whole_files(spark, directories)
    head = F.when(F.col("value").startswith("---"), F.element_at(F.split("value", "---", 3), 2)).otherwise("")
    body = F.when(F.col("value").startswith("---"), F.element_at(F.split("value", "---", 3), 3)).otherwise(F.col("value"))
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.startswith("#") & ~x.startswith(">"))
    return files.select("path", field("domain").alias("domain"), field("date").alias("date"), field("tags").alias("tags"), F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 200).alias("summary"), body.alias("body"))


def search_notes(notes: DataFrame, query: str, most: int = 10, search_body: bool = True, general: DataFrame | None = None, tech_words: list[str] = ()) -> DataFrame:
    """Notes whose file name, else whose first 2000 characters, match the query; names first, then by path. general: notes of no domain, which count if their name matches and their text has one of the words."""
    from quillrank.functions.text import matches_query

    name = F.regexp_extract("path", "[^/]*$", 0)
    rank = F.when(matches_query(F.lit(query), name), 0)
    if search_body:
        rank = rank.when(matches_query(F.lit(query), F.substring("body", 1, 2000)), 1)
    found = notes.withColumn("priority", rank)
    if general is not None and tech_words:
        spoken = reduce(lambda a, b: a | b, [F.contains(F.lower("body"), F.lit(w.lower())) for w in tech_words])
        found = found.unionByName(general.withColumn("priority", F.when(matches_query(F.lit(query), name) & spoken, 2)))
    return found.filter("priority is not null").orderBy("priority", "path").limit(most)


def note_text(notes: DataFrame) -> DataFrame:
    """notes (title, domain, date, tags array, findings array, sources array) with `value`: each as one Markdown note with a head."""
    lines = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("---\ndomain: "), F.coalesce("domain", F.lit("")), F.lit("\ndate: "), F.coalesce(F.col("date").cast("string"), F.lit("")), F.lit("\ntags: "), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("\n---\n# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return notes.withColumn("value", F.concat(head, lines("Findings", F.coalesce("findings", F.array().cast("array<string>"))), lines("Sources", F.coalesce("sources", F.array().cast("array<string>")))))


def write_notes(notes: DataFrame, path: str) -> None:
    """The notes as text files below path, one folder a slug of the title; a note that is there is added to."""
    from quillrank.functions.text import slug

    made = note_text(notes).select(slug(F.col("title")).alias("note"), "value")
    made.write.mode("append").partitionBy("note").option("lineSep", "\n").text(path)


def recent_files(spark: SparkSession, directories: list[str], now: datetime, hours: int = 48) -> DataFrame:
    """(path, dir_pos, value) of Markdown files changed in the last hours."""
    return whole_files(spark, directories, modified_after=(now - timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S"))


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value, error) of program text files: one row a path; a file that is missing or no program text has an error and no value."""
    ok = [p for p in paths if p.lower().rpartition(".")[2] in SOURCE_SUFFIXES and exists(spark, p)]
    wrong = [(p, None, "no program text" if exists(spark, p) else "no such file") for p in paths if p not in ok]
    out = spark.createDataFrame(wrong, "path string, value string, error string")
    for p in ok:
        out = out.unionByName(spark.read.text(p, wholetext=True).select(F.lit(p).alias("path"), "value", F.lit(None).cast("string").alias("error")))
    return out


def source_files(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(path, value) of program text files."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return whole_files(spark, directories, "*").filter(suffix.isin(*SOURCE_SUFFIXES)).select("path", "value")
