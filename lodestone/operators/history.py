"""History of files: commits (sha, seq, path and more), blame lines (path, author, email, lines)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch

#: Commits of the recent window, co-changes at least, per cent of the file's commits at least, co-changed files at most.
RECENT, CHANGES, PERCENT, PARTNERS = 500, 3, 50.0, 5


def ownership(blame: DataFrame) -> DataFrame:
    """path, author, email (the first by name), lines, percentage of the path's lines."""
    own = blame.groupBy("path", "author").agg(F.min("email").alias("email"), F.sum("lines").cast("long").alias("lines"))
    total = own.groupBy("path").agg(F.sum("lines").alias("total"))
    return own.join(total, "path").select("path", "author", "email", "lines", F.round(F.col("lines") * 100.0 / F.col("total"), 6).alias("percentage"))


def main_owner(blame: DataFrame) -> DataFrame:
    """Of each path the author with most lines, the first by name of several."""
    own = ownership(blame)
    best = own.groupBy("path").agg(F.min(F.struct((-F.col("lines")).alias("k"), "author", "percentage")).alias("x"))
    return best.select("path", F.col("x.author").alias("author"), F.col("x.percentage").alias("percentage"))


def frequency(commits: DataFrame, most: int = RECENT) -> DataFrame:
    """path, commits that touch it, `most` at most."""
    return commits.select("path", "sha").distinct().groupBy("path").agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("frequency"))


def recent_commits(commits: DataFrame, most: int = RECENT) -> DataFrame:
    """Rows of the `most` newest commits (largest seq) of the whole history."""
    newest = commits.select("sha", "seq").distinct().orderBy(F.desc("seq"), "sha").limit(most).select("sha")
    return commits.join(F.broadcast(newest), "sha", "left_semi")


def commit_files(commits: DataFrame) -> DataFrame:
    """sha, its distinct paths in order joined by commas, how many."""
    own = commits.select("sha", "path").distinct().groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("all"))
    return own.select("sha", F.array_join("all", ",").alias("paths"), F.size("all").cast("long").alias("n_paths"))


#: Files of a commit up to which all its pairs are counted.
WIDE = 256


def co_changes(commits: DataFrame, at_least: int = CHANGES, percent: float = PERCENT, most: int = PARTNERS, of=None, wide: int = WIDE) -> DataFrame:
    """path, other, together, percentage: the `most` files most often committed together with each path (or with those in `of`).

    All pairs of a commit are counted only if it touches `wide` files at most. Wider ones are looked up for candidates: a path of t commits needs c = max(at_least,
    percent of t) of them with another, so if fewer than c are wide, the two meet in another commit; if more are, they meet in one of all
    but the c - 1 widest of these, which then gives the candidates."""
    each = scratch(commits.select("sha", "path").distinct(), "touches")
    mine = each if of is None else each.where(F.col("path").isin(*of))
    need = F.greatest(F.lit(at_least), F.ceil(F.lit(percent) * F.col("total") / 100 - 1e-9)).cast("long")
    total = mine.groupBy("path").agg(F.count("*").alias("total")).withColumn("need", need).where("total >= need")
    broad = scratch(each.groupBy("sha").agg(F.count("*").alias("size")).where(F.col("size") > wide), "broad")
    some = not broad.isEmpty()
    narrow = lambda df: df.join(broad.select("sha"), "sha", "left_anti") if some else df
    pairs = lambda df: df.groupBy("path", "other").agg(F.count("*").cast("long").alias("together"))
    others = each.withColumnRenamed("path", "other")
    both = pairs(narrow(mine).join(narrow(others), "sha").where("path <> other"))
    if some:
        ours, theirs = mine.join(broad, "sha").join(total, "path"), others.join(broad.select("sha"), "sha", "left_semi")
        few = ours.groupBy("path").agg(F.count("*").alias("n"))
        enough = both.join(total, "path").join(few, "path", "left").where(F.col("together") + F.coalesce("n", F.lit(0)) >= F.col("need")).select("path", "other")
        place = F.row_number().over(Window.partitionBy("path").orderBy("size", "sha"))
        first = ours.withColumn("at", place).join(few, "path").where(F.col("at") <= F.col("n") - F.col("need") + 1)
        meet = first.join(theirs, "sha").where("path <> other").select("path", "other")
        asked = enough.unionByName(meet).distinct()
        late = pairs(asked.join(ours.select("path", "sha"), "path").join(theirs, ["sha", "other"]))
        both = both.unionByName(late).groupBy("path", "other").agg(F.sum("together").cast("long").alias("together"))
    both = both.join(total, "path").where("together >= need").withColumn("percentage", F.round(F.col("together") * 100.0 / F.col("total"), 6))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("together"), "other"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("path", "other", "together", "percentage", "rank")


def newest_of(commits: DataFrame, n: int = 10) -> DataFrame:
    """path, rank, sha, day: the newest n commits of each path. Days are UTC."""
    each = commits.select("path", "sha", "seq", "ts").distinct()
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), "sha"))
    return each.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max(1, min(n, RECENT))).select("path", "rank", "sha", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def age(commits: DataFrame, as_of: date) -> DataFrame:
    """path, first and last day, days since the last one up to as_of, 0 at least."""
    days = commits.groupBy("path").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    since = F.greatest(F.datediff(F.lit(as_of), "b"), F.lit(0)).cast("long")
    return days.select("path", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"), since.alias("days_since"))


def hotspots(commits: DataFrame, spans: DataFrame, most: int = RECENT) -> DataFrame:
    """path, frequency, span, score = frequency * span, for the paths of spans (path, span) that were touched."""
    found = frequency(commits, most).join(spans, "path")
    return found.select("path", "frequency", F.coalesce("span", F.lit(0)).cast("long").alias("span")).withColumn("score", F.col("frequency") * F.col("span"))


def context(commits: DataFrame, blame: DataFrame, as_of: date, percent: float = PERCENT) -> DataFrame:
    """One row a path: frequency, age, main owner and co-changed files joined by commas."""
    pairs = co_changes(commits, percent=percent).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("x"))
    pairs = pairs.select("path", F.array_join(F.transform("x", lambda x: x["other"]), ",").alias("partners"))
    out = frequency(commits).join(age(commits, as_of), "path").join(main_owner(blame), "path", "left").join(pairs, "path", "left")
    return out.select("path", "frequency", "first_day", "last_day", "days_since", F.col("author").alias("owner"), F.col("percentage").alias("owner_percentage"), F.coalesce("partners", F.lit("")).alias("partners"))
