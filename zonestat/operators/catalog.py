"""Catalog tables: places, items of materialised series, overlays, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids (place_id, collection or null) to one index row each: the collection asked for, else the first by rank; with ``ambiguous``."""
    rows = wanted.select("place_id", F.col("collection").alias("wanted")).join(index, "place_id")
    order = Window.partitionBy("place_id", "wanted").orderBy(F.coalesce(F.col("collection") == F.col("wanted"), F.lit(False)).desc(), "rank", "collection")
    count = F.count("*").over(Window.partitionBy("place_id", "wanted"))
    return rows.withColumns({"first_": F.row_number().over(order), "ambiguous": count > 1}).where("first_ = 1").drop("first_")


def resolve_datasets(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names to datasets that aren't pending: exact id, id without case, id under erddap/, then dataset id without case."""
    low = F.lower
    under = F.when(low("id").startswith("erddap/"), F.substring(low("id"), 8, 1 << 20))
    names = F.explode(F.array(*[F.struct(F.lit(how).alias("how"), name.alias("name")) for how, name in ((2, low("id")), (3, under), (4, low("dataset_id")))]))
    known = registry.where(~F.col("pending")).select("*", names.alias("n")).select("*", "n.how", "n.name").drop("n").where("name is not null")
    rows = wanted.join(known, low("wanted") == F.col("name")).drop("name")
    how = F.when(F.col("wanted") == F.col("id"), 1).otherwise(F.col("how"))
    first = F.row_number().over(Window.partitionBy("wanted").orderBy("how", "id"))
    return rows.withColumn("how", how).withColumn("first_", first).where("first_ = 1").drop("first_")


def capped(rows: DataFrame, group: str, order: list, cap: int | Column) -> DataFrame:
    """At most ``cap`` rows of each group in order, with ``place`` and ``more``, the count of those not shown."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    more = F.greatest(F.count("*").over(Window.partitionBy(group)) - cap, F.lit(0))
    return rows.withColumns({"place": place.cast("long"), "more": more.cast("long")}).where(F.col("place") <= cap)


def search(hits: DataFrame, group: str, order: list, limit: int = 200, least: int = 10, most: int = 50) -> DataFrame:
    """Hits by group, each with its share of ``limit``."""
    groups = hits.select(group).distinct().agg(F.count("*").alias("groups_"))  # one row
    share = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(limit) / F.col("groups_"))))
    return capped(hits.crossJoin(F.broadcast(groups)), group, order, share).drop("groups_")


def rank_matches(places: DataFrame, query: str, name: str = "name", area: str = "area_km2") -> DataFrame:
    """Places whose names match, in order: the same name, a beginning, a word's beginning, anywhere; then the larger area."""
    low, q = F.lower(name), query.lower()
    rank = F.when(low == q, 1).when(low.startswith(q), 2).when(low.contains(" " + q), 3).when(low.contains(q), 4)
    return places.withColumn("match", rank).where(F.col("match").isNotNull()).orderBy("match", F.desc(area), name)


def suffix_repeats(rows: DataFrame, id_col: str, label_col: str, order: list) -> DataFrame:
    """Unique ids: the first by order keeps its id, others get ``:label``, and ``-k`` from the second of one label."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    rows = rows.withColumn("nth_", nth)
    again = F.row_number().over(Window.partitionBy(id_col, label_col, F.col("nth_") > 1).orderBy(*order))
    suffix = F.concat(F.lit(":"), F.col(label_col), F.when(F.col("again_") > 1, F.concat(F.lit("-"), F.col("again_").cast("string"))).otherwise(""))
    return rows.withColumn("again_", again).withColumn("unique_id", F.when(F.col("nth_") == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), suffix))).drop("nth_", "again_")


def pending(planned: DataFrame, have: DataFrame, key: str = "id") -> DataFrame:
    """Planned items that don't exist yet, each once."""
    return planned.join(have.select(key), key, "left_anti").dropDuplicates([key])


def merge_items(fresh: DataFrame, earlier: DataFrame, keep: Column, key: str = "id") -> DataFrame:
    """Fresh items, and earlier ones that aren't among them and are still wanted."""
    return fresh.unionByName(earlier.where(keep).join(fresh.select(key), key, "left_anti"))


def listed(items: DataFrame, covered: DataFrame, key: str = "place_id") -> DataFrame:
    return items.join(covered.select(key), key, "left_semi")


def unlisted(files: DataFrame, links: DataFrame, key: str = "path") -> DataFrame:
    return files.join(links.select(key), key, "left_anti")


def overlay_status(rows: DataFrame, overlay: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the overlay's values in place of their own, matched by trimmed key."""
    side = overlay.select(F.trim(key).alias("key_"), *[F.col(c).alias(f"{c}_over") for c in columns])
    joined = rows.withColumn("key_", F.trim(key)).join(side, "key_", "left")
    return joined.select(*[F.coalesce(f"{c}_over", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def overlay_unmatched(rows: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Overlay rows that no row takes: their maker is warned."""
    return overlay.withColumn("key_", F.trim(key)).join(rows.select(F.trim(key).alias("key_")), "key_", "left_anti").drop("key_")


def overlay_repeats(overlay: DataFrame, key: str) -> DataFrame:
    """Keys that an overlay has more than once, which is an error."""
    return overlay.groupBy(F.trim(key).alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def source_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """By slug and ordinal, why a source must be read again (reason; null if not): new, edited, count, checksum or etag."""
    old = before.select("slug", "ordinal", *[F.col(c).alias(f"old_{c}") for c in ("edited", "count", "checksum", "etag")])
    other = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    rows = now.join(old.withColumn("had", F.lit(True)), ["slug", "ordinal"], "left")
    reason = F.when(F.col("had").isNull(), "new").when(other("edited"), "edited").when(other("count"), "count").when(other("checksum"), "checksum").when(other("etag"), "etag")
    return rows.select("slug", "ordinal", reason.alias("reason"))


def roll_up(items: DataFrame, by: str = "collection") -> DataFrame:
    """A collection's extent and contents: start, end, items, places, variables (sorted)."""
    return items.groupBy(by).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("items"), F.count_distinct("place_id").alias("places"), F.array_join(F.array_sort(F.collect_set("variable")), ",").alias("variables")
    )


def first_providers(providers: DataFrame) -> DataFrame:
    """Each provider once, as its first dataset in order has it."""
    return providers.groupBy("name").agg(F.min(F.struct("ord", "url", "role")).alias("first")).select("name", "first.ord", "first.url", "first.role")


def outages(failures: DataFrame) -> DataFrame:
    """By host: the kinds of failure, first and last time, and the units that failed (sorted)."""
    return failures.groupBy("host").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_distinct("unit").alias("units")
    )


def run_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("units"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def group_ranks(places: DataFrame, manifest: DataFrame, curated: tuple[str, ...], folded: tuple[str, ...] = ()) -> DataFrame:
    """Places with the place of their collection in a list: the curated ones in their order, then the manifest's (slug, rank), then others by name.

    ``shown`` is false for collections that a short list folds away: those that aren't curated, and ``folded`` ones.
    """
    fixed = F.element_at(F.create_map(*[F.lit(v) for k, c in enumerate(curated) for v in (c, k)]), F.col("collection")) if curated else F.lit(None).cast("int")
    ranked = places.join(manifest.select(F.col("slug").alias("collection"), F.col("rank").alias("rank_")), "collection", "left")
    about = F.struct(F.coalesce(fixed, F.lit(len(curated))).cast("long").alias("curated"), F.coalesce(F.col("rank_").cast("long"), F.lit((1 << 62))).alias("rank"), F.col("collection").alias("slug"))
    shown = fixed.isNotNull() & ~F.col("collection").isin(list(folded)) if folded else fixed.isNotNull()
    return ranked.withColumns({"group_order": about, "shown": shown}).drop("rank_")


def sections(ranked: DataFrame, cap: int = 50) -> DataFrame:
    """The rows of each collection by name, at most ``cap``, with how many more there are, collections in order."""
    return capped(ranked, "collection", [F.col("name"), F.col("place_id")], cap).orderBy("group_order", "place")


def by_name(rows: DataFrame) -> DataFrame:
    """One list from A to Z, equal names by id."""
    return rows.orderBy("name", "place_id")


#: What failed attempts say when a host was out of reach: a pattern and its kind.
UNREACHED = ((r"(?i)^HTTP 5\d\d", "5xx"), (r"(?i)time(d )?-?out|no response|abort", "timeout"), (r"(?i)fetch failed|terminated|network|ECONN|ENOTFOUND|EAI_AGAIN|socket", "network"))


def failure_kind(message: Column) -> Column:
    """5xx, timeout or network where a message tells of an outage; null for an error of the unit itself."""
    told = F.lit(None).cast("string")
    for pattern, kind in reversed(UNREACHED):
        told = F.when(message.rlike(pattern), kind).otherwise(told)
    return told


def outcomes(units: DataFrame, attempts: DataFrame) -> DataFrame:
    """By unit (unit, host) of a run: status completed, skipped, error or deferred, kind, tries and reason.

    ``attempts`` has unit, host, at, ok and message. A unit's last attempt decides: done, an outage (skipped), or its own error. A unit
    without attempts is skipped if its host's last attempt of all was an outage, else deferred to the next run.
    """
    tried = attempts.withColumn("kind", F.when(~F.col("ok"), failure_kind(F.coalesce("message", F.lit("")))))
    last = lambda df, key: df.groupBy(key).agg(F.max(F.struct("at", "ok", "kind", "message")).alias("last"), F.count_if(~F.col("ok") & F.col("kind").isNotNull()).alias("tries"))
    own = last(tried, "unit").select("unit", F.col("last").alias("own"), "tries")
    host = last(tried, "host").select("host", F.col("last").alias("of_host"))  # a row for each host
    rows = units.select("unit", "host").join(own, "unit", "left").join(host, "host", "left")
    down = ~F.col("of_host.ok") & F.col("of_host.kind").isNotNull()
    status = (
        F.when(F.col("own.ok"), "completed").when(F.col("own").isNotNull() & F.col("own.kind").isNotNull(), "skipped").when(F.col("own").isNotNull(), "error")
        .when(down, "skipped").otherwise("deferred")
    )
    reason = F.when(status == "completed", F.lit(None).cast("string")).when(F.col("own").isNotNull(), F.split(F.coalesce("own.message", F.lit("")), "\n")[0]).when(down, "not reached: host still down")
    kind = F.when(status == "skipped", F.coalesce("own.kind", "of_host.kind"))
    return rows.select("unit", "host", status.alias("status"), kind.alias("kind"), F.coalesce("tries", F.lit(0)).alias("tries"), reason.alias("reason"))
