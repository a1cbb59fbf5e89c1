"""Incremental ingest: first sightings, change detection, skip rules, worklists, windows and run counters."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text

#: Star floors and age of the skip rules, results of one source query, and the star bands.
FORK_STARS, ARCHIVED_STARS, STALE_MONTHS, WINDOW_LIMIT, REFRESH_DAYS = 200, 1000, 24, 1000, 30
STAR_BANDS = (">5000", "1000..5000", "500..999", "200..499", "100..199", "50..99", "20..49", "10..19", "5..9", "3..4", "2", "1", "0")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the order: an aggregate with map-side combine, no window or sort."""
    rest = [c for c in df.columns if c not in key]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*key).agg(least.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    most = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*key).agg(most.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def outcomes(incoming: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Incoming rows with their outcome: new, changed or unchanged against the known corpus."""
    old = known.select(F.col(key).alias("_key"), F.col(digest).alias("_digest"))
    o = F.when(F.col("_key").isNull(), "new").when(F.col("_digest").eqNullSafe(F.col(digest)), "unchanged").otherwise("changed")
    return incoming.join(old, F.col(key) == F.col("_key"), "left").withColumn("outcome", o).drop("_key", "_digest")


def counters(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("outcome") == o).alias(f"repos_{o}") for o in ("new", "changed", "unchanged")])


def pending(windows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return windows.join(done.select(key), key, "left_anti")


def is_fresh(fetched: Column, ttl_seconds: Column, now: Column) -> Column:
    """Age strictly below the time to live."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched.cast("timestamp"))) / 1e6
    return F.coalesce(age < ttl_seconds, F.lit(False))


def is_expired(fetched: Column, now: Column, days: int = REFRESH_DAYS) -> Column:
    """Older than the limit, from the future, or unreadable."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched.cast("timestamp"))) / 8.64e10
    return ~F.coalesce(age >= 0, F.lit(False)) | (age > days)


def skip_reason(fork: Column, archived: Column, stars: Column, pushed: Column, now: Column) -> Column:
    stale = pushed.isNull() | (pushed.cast("timestamp") < F.add_months(now, -STALE_MONTHS).cast("timestamp"))
    return F.when(fork & (stars <= FORK_STARS), "fork").when(archived & (stars <= ARCHIVED_STARS) & stale, "archived-stale")


def worklist(repos: DataFrame, limit: int, shards: int = 1, index: int = 0) -> DataFrame:
    """The next repositories to fetch: most stars first, names that differ in case once, own shard only.

    ``limit * shards`` are taken before the filters, as both drop rows.
    """
    top = repos.orderBy(F.desc("stars"), "full_name").limit(limit * max(1, shards))
    first = F.row_number().over(Window.partitionBy(F.lower("full_name")).orderBy(F.desc("stars"), "full_name"))
    own = top.where(text.is_repo_name(F.col("full_name"))).where(text.shard_of(F.col("full_name"), shards) == index)
    return own.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("stars"), "full_name").limit(limit)


def star_band(stars: Column) -> Column:
    out = F.lit(None).cast("string")
    for band in STAR_BANDS:
        if band.startswith(">"):
            test = stars > int(band[1:])
        elif ".." in band:
            test = stars.between(*map(int, band.split("..")))
        else:
            test = stars == int(band)
        out = F.when(test, band).otherwise(out)
    return out


def window_plan(rows: DataFrame, band: Column, day: Column, years_until: int, limit: int = WINDOW_LIMIT) -> DataFrame:
    """(band, created, hits, fits): the coarsest calendar windows of each band that hold at most ``limit`` rows.

    A band splits into one bucket of the years up to ``years_until`` and single years, the bucket into
    years, then quarters, months and days; a day over the limit is kept and doesn't fit. Counts of all
    levels come from one count by day and sums over it.
    """
    d = rows.select(band.alias("band"), F.to_date(day).alias("d")).groupBy("band", "d").agg(F.count(F.lit(1)).alias("n"))
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    span = lambda a, b: F.concat(date(a), F.lit(".."), date(b))
    year, quarter, month = F.trunc("d", "year"), F.trunc("d", "quarter"), F.trunc("d", "month")
    bucket = F.when(F.year("d") <= years_until, F.concat(F.lit(f"..{years_until}-12-31")))
    names = {
        "all": F.lit(""), "bucket": bucket, "year": span(year, F.last_day(F.add_months(year, 11))),
        "quarter": span(quarter, F.last_day(F.add_months(quarter, 2))), "month": span(month, F.last_day(F.col("d"))), "day": date(F.col("d")),
    }
    d = d.withColumns({f"w_{k}": v for k, v in names.items()})
    for k in names:
        d = d.withColumn(f"n_{k}", F.sum("n").over(Window.partitionBy("band", f"w_{k}")))
    chosen = F.col("w_day")
    hits = F.col("n_day")
    for k in ("month", "quarter", "year", "bucket", "all"):
        ok = F.col(f"w_{k}").isNotNull() & (F.col(f"n_{k}") <= limit)
        chosen, hits = F.when(ok, F.col(f"w_{k}")).otherwise(chosen), F.when(ok, F.col(f"n_{k}")).otherwise(hits)
    return d.select("band", chosen.alias("created"), hits.alias("hits")).distinct().withColumn("fits", F.col("hits") <= limit)


def children(window: str) -> list[str]:
    """The windows that a calendar window ``from..to`` or day splits into; none for a day."""
    import calendar

    if ".." not in window:
        return []
    (y, m, _), (y2, m2, _) = (tuple(map(int, x.split("-"))) for x in window.split(".."))
    months = lambda y, a, b: f"{y:04d}-{a:02d}-01..{y:04d}-{b:02d}-{calendar.monthrange(y, b)[1]:02d}"
    if y < y2:
        return [months(x, 1, 12) for x in range(y, y2 + 1)]
    if m2 - m == 11:
        return [months(y, q, q + 2) for q in (1, 4, 7, 10)]
    if m2 - m == 2:
        return [months(y, x, x) for x in range(m, m2 + 1)]
    return [f"{y:04d}-{m:02d}-{x:02d}" for x in range(1, calendar.monthrange(y, m)[1] + 1)]


class WindowChildren:
    """(child) of a window: ``children`` as a table function, so that windows split in tasks, by lateral join."""

    def eval(self, window: str):
        for child in children(window) if window else ():
            yield (child,)


def split_windows(windows: DataFrame, column: str = "window") -> DataFrame:
    """The rows of windows that can be split, once for each part, with the part as ``child``."""
    part = F.udtf(WindowChildren, returnType="child string", useArrow=True)
    return windows.lateralJoin(part(F.col(column).outer()))


def window_tree(spans: DataFrame, column: str = "window") -> DataFrame:
    """All windows below some, level by level, with ``level`` (0 for those given): years, quarters, months, days."""
    level = spans.withColumn("level", F.lit(0))
    out = [level]
    for _ in range(4):
        level = split_windows(level, column).withColumns({column: F.col("child"), "level": F.col("level") + 1}).drop("child")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def query_text(base: Column, band: Column, created: Column) -> Column:
    """The source query that a window stands for."""
    stars = F.concat(F.lit("stars:"), band)
    return F.concat_ws(" ", base, stars, F.when(created != "", F.concat(F.lit("created:"), created)))


def owner_worklist(repos: DataFrame, owner: str) -> DataFrame:
    """All repositories of an owner, most stars first."""
    return repos.where(F.col("owner") == owner).orderBy(F.desc("stars"), "full_name")


def batches(df: DataFrame, size: int) -> DataFrame:
    """Adds batch: rows dealt into batches of at most ``size``, within partitions, so no row moves and no task numbers all rows."""
    place = F.monotonically_increasing_id()
    bits = (1 << 33) - 1  # the lower bits count a partition's rows, the upper ones the partitions
    return df.withColumn("_place", place).withColumn("batch", F.concat_ws("-", F.shiftright("_place", 33), F.floor(F.col("_place").bitwiseAND(bits) / size))).drop("_place")


def with_total(df: DataFrame, by: Sequence[Column], limit: int) -> DataFrame:
    """The first rows in order, each with the number of all rows; the count is an aggregate of its own."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*by).limit(limit).join(F.broadcast(total))  # one row


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repetition."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def day_list(first: Column, last: Column) -> Column:
    """All days from first to last as ``yyyy-MM-dd``."""
    return F.transform(F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day")), lambda d: F.date_format(d, "yyyy-MM-dd"))


def artifacts(repos: DataFrame, readme: DataFrame, tree: DataFrame, manifests: DataFrame, releases: DataFrame) -> DataFrame:
    """Repositories with their readme, tree, manifests as a map by name and releases, newest first, by left joins on repo."""
    m = manifests.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "content")))).alias("manifests"))
    t = tree.groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("tree"))
    r = releases.groupBy("repo").agg(F.reverse(F.array_sort(F.collect_list("published_at"))).alias("releases"))
    out = repos
    for part in (readme, t, m, r):
        out = out.join(part, "repo", "left")
    return out.withColumn("latest_release_at", F.try_element_at("releases", F.lit(1)))


def generated(spark, n: int, families: dict[str, Sequence[str]], seed: int = 1) -> DataFrame:
    """A corpus of n documents made from hashes: every value of each family occurs, stars are skewed, some are archived."""
    ids = spark.range(n)
    pick = lambda salt, k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), F.col("id"))), 1, 15), 16, 10).cast("long") % k
    values = {f: F.element_at(F.array(*[F.lit(v) for v in vs]), ((F.col("id") + pick(f, 3) * len(vs)) % len(vs) + 1).cast("int")) for f, vs in families.items()}
    stars = F.pow(F.lit(10.0), pick("stars", 4500) / 1000).cast("long")
    owner = F.concat(F.lit("owner"), pick("owner", max(1, n // 4)).cast("string"))
    return ids.select("id", owner.alias("owner"), F.concat(owner, F.lit("/tool"), F.col("id").cast("string")).alias("full_name"), stars.alias("stars"), (pick("archived", 100) < 6).alias("archived"), (pick("relevance", 101) / 100).alias("k8s_relevance"), *[c.alias(f) for f, c in values.items()])
