"""Changes of a corpus and feedback as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86400.0


def watch_files(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """Files as they appear: path, value, modified. Changes and deletions of old files need a snapshot difference."""
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true")
    return reader.format("text").load(directory).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def quiet_periods(changes: DataFrame, ts: str = "ts", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, end, changes): bursts of changes that a quiet time of `gap` ends; each calls for one rebuild."""
    return changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("changes")).select("w.start", "w.end", "changes")


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, interval: str = "2 seconds"):
    """Calls rebuild(batch) for every micro-batch that has changes."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild(batch)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def decayed_boosts(corrections: DataFrame, half_life_days: float = 7.0, keep_days: float = 30.0, ts: str = "ts") -> DataFrame:
    """Stream of (qhash, skill, boost, ts): corrections (qhash, skill, boost, ts) added up per query, each decayed to the query's latest; a query that is not corrected for `keep_days` of event time is forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, held = (state.get[0], dict(zip(state.get[1], state.get[2]))) if state.exists else (0.0, {})
        for f in frames:
            for skill, boost, when in zip(f["skill"], f["boost"], f["at"]):
                if when - at > keep_days * DAY:
                    held = {}
                now = max(at, when)
                held = {s: b * 0.5 ** ((now - at) / (half_life_days * DAY)) for s, b in held.items()} if held else {}
                held[skill] = held.get(skill, 0.0) + boost * 0.5 ** ((now - when) / (half_life_days * DAY))
                at = now
        state.update((at, list(held), [float(b) for b in held.values()]))
        state.setTimeoutTimestamp(max(int((at + keep_days * DAY) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"qhash": key[0], "skill": list(held), "boost": list(held.values()), "ts": pd.to_datetime([at] * len(held), unit="s")})

    timed = corrections.withWatermark(ts, "1 hour").select("qhash", "skill", "boost", F.col(ts), F.col(ts).cast("double").alias("at"))
    return timed.groupBy("qhash").applyInPandasWithState(update, "qhash string, skill string, boost double, ts timestamp", "at double, skills array<string>, boosts array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def live_posteriors(observations: DataFrame, ts: str = "ts") -> DataFrame:
    """Stream of (qhash, skill, alpha, beta): observations (qhash, skill, weight, seq, ts) as they come; own weights go to alpha, a fifth of another skill's weight to the beta of every skill seen before it under the query."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        skills, alpha, beta = (list(x) for x in state.get) if state.exists else ([], [], [])
        place = {s: i for i, s in enumerate(skills)}
        rows = sorted((seq, skill, weight) for f in frames for seq, skill, weight in zip(f["seq"], f["skill"], f["weight"]))
        for _, skill, weight in rows:
            if skill not in place:
                place[skill] = len(skills)
                skills.append(skill)
                alpha.append(1.0)
                beta.append(1.0)
            for i in range(len(skills)):
                if i == place[skill]:
                    alpha[i] += float(weight)
                else:
                    beta[i] += 0.2 * float(weight)
        state.update((skills, alpha, beta))
        yield pd.DataFrame({"qhash": key[0], "skill": skills, "alpha": alpha, "beta": beta})

    rows = observations.select("qhash", "skill", "weight", "seq")
    return rows.groupBy("qhash").applyInPandasWithState(update, "qhash string, skill string, alpha double, beta double", "skills array<string>, alpha array<double>, beta array<double>", "update", GroupStateTimeout.NoTimeout)


def live_counts(observations: DataFrame) -> DataFrame:
    """Stream of (qhash, skill, alpha): 1 + observed weights, as they stand."""
    return observations.groupBy("qhash", "skill").agg((1.0 + F.sum("weight")).alias("alpha"))
