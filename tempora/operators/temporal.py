"""Bitemporal reads: visibility, history, changes, overlap, coverage and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tempora.functions.lineage import materialize

#: Rows of a key above which its running folds are made in ranges, side by side.
HOT = 1 << 20


def _rank() -> Column:
    """What the winning version of an identity has most of: late in transaction time, high version, then a put, then early in the log."""
    return F.struct("tx_time", "version", ~F.col("tombstone"), -F.col("log_index"), -F.col("ordinal"))


def candidates(history: DataFrame, valid_at, tx_at) -> DataFrame:
    """Puts valid at valid_at and all tombstones, recorded by tx_at."""
    valid = (F.col("valid_from") <= F.lit(valid_at)) & (F.lit(valid_at) < F.col("valid_to"))
    return history.where((F.col("tx_time") <= F.lit(tx_at)) & (F.col("tombstone") | valid))


def winners(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """The winning version of each identity, deletes included; only the columns asked for are carried through the aggregation."""
    by = by or ["id"]
    carried = [c for c in columns if c not in by]
    rows = rows.groupBy(*by).agg(F.max_by(F.struct("tombstone", *[c for c in carried if c != "tombstone"]), _rank()).alias("w"))
    return rows.select(*by, *[F.col(f"w.{c}").alias(c) for c in dict.fromkeys([*carried, "tombstone"])])


def visible(history: DataFrame, valid_at, tx_at, columns: list[str] | None = None) -> DataFrame:
    """What is visible at (valid_at, tx_at), one row per identity. Predicates on other columns belong above this."""
    columns = columns if columns is not None else [c for c in history.columns if c not in ("tombstone",)]
    out = winners(candidates(history, valid_at, tx_at), columns).where(~F.col("tombstone"))
    return out.select(*dict.fromkeys(["id", *columns]))


def point(history: DataFrame, identity, valid_at, tx_at, columns: list[str] | None = None) -> DataFrame:
    """visible() of one identity; the identity is filtered first, which is safe and reaches the scan."""
    return visible(history.where(F.col("id") == F.lit(identity)), valid_at, tx_at, columns)


def page(rows: DataFrame, after=None, limit: int | None = None) -> DataFrame:
    """Rows by ascending id past an exclusive cursor, at most limit."""
    rows = rows if after is None else rows.where(F.col("id") > F.lit(after))
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def history_of(history: DataFrame, identity, tx_from, tx_through, limit: int | None = None) -> DataFrame:
    """All puts of an identity with transaction time in the closed range, by time and version."""
    rows = history.where((F.col("id") == F.lit(identity)) & F.col("tx_time").between(F.lit(tx_from), F.lit(tx_through)) & ~F.col("tombstone"))
    rows = rows.orderBy("tx_time", "version", "log_index", "ordinal")
    return rows if limit is None else rows.limit(limit)


def change_log(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """All records of both histories as one log: kind put or delete, and the entity kind."""
    def part(df: DataFrame, entity: str) -> DataFrame:
        return df.select("log_index", "ordinal", F.lit(entity).alias("entity"), F.when(F.col("tombstone"), "delete").otherwise("put").alias("change_kind"), "id", "version", "tx_time", "valid_from", "valid_to")

    return part(vertices, "vertex").unionByName(part(edges, "edge"))


def changes(log: DataFrame, after: tuple[int, int] | None, through: int, limit: int | None = None) -> DataFrame:
    """Log records past an exclusive (log_index, ordinal) cursor up to log index through, in log order."""
    rows = log.where(F.col("log_index") <= F.lit(through))
    if after is not None:
        rows = rows.where((F.col("log_index") > after[0]) | ((F.col("log_index") == after[0]) & (F.col("ordinal") > after[1])))
    rows = rows.orderBy("log_index", "ordinal", "entity", "id")
    return rows if limit is None else rows.limit(limit)


def next_cursor(log: DataFrame, after: tuple[int, int] | None, through: int, limit: int) -> tuple[int, int] | None:
    """The cursor to go on from after a page of limit records, if there are more."""
    rows = changes(log, after, through, limit + 1).select("log_index", "ordinal").offset(limit - 1).collect()  # the last of the page and one more
    return tuple(rows[0]) if len(rows) > 1 else None


def alive(history: DataFrame) -> DataFrame:
    """The puts that no later delete of their identity has ended."""
    dead = history.where("tombstone").groupBy("id").agg(F.max(F.struct("tx_time", "version")).alias("dead"))
    puts = history.where(~F.col("tombstone")).join(dead, "id", "left")
    return puts.where(F.col("dead").isNull() | (F.struct("tx_time", "version") >= F.col("dead"))).drop("dead")


def overlapping(history: DataFrame, start, end, tx_at, columns: list[str] | None = None) -> DataFrame:
    """Versions known at tx_at that overlap [start, end): the latest of each valid_from, past the identity's last tombstone."""
    columns = columns if columns is not None else [c for c in history.columns if c != "tombstone"]
    known = history.where(F.col("tx_time") <= F.lit(tx_at))
    carried = list(dict.fromkeys(["tx_time", "version", "valid_to", *columns]))
    puts = known.where(~F.col("tombstone") & (F.col("valid_from") < F.lit(end)) & (F.lit(start) < F.col("valid_to")))
    latest = winners(puts, carried, ["id", "valid_from"])
    dead = known.where("tombstone").groupBy("id").agg(F.max(F.struct("tx_time", "version")).alias("dead"))
    alive = latest.join(dead, "id", "left").where(F.col("dead").isNull() | (F.struct("tx_time", "version") >= F.col("dead")))
    return alive.select(*dict.fromkeys(["id", *columns]))


def system_changes(history: DataFrame, first, last) -> DataFrame:
    """Records with transaction time in the closed range, with their kind."""
    return history.where(F.col("tx_time").between(F.lit(first), F.lit(last))).withColumn("change_kind", F.when(F.col("tombstone"), "delete").otherwise("put"))


def valid_changes(history: DataFrame, first, last, tx_at) -> DataFrame:
    """Versions known at tx_at that begin or end within the closed range of valid time."""
    rows = overlapping(history, -(1 << 63), (1 << 63) - 1, tx_at, [c for c in history.columns if c != "tombstone"])
    begins, ends = F.col("valid_from").between(F.lit(first), F.lit(last)), F.col("valid_to").between(F.lit(first), F.lit(last))
    return rows.where(begins | ends).withColumn("change_kind", F.when(begins & ends, "both").when(begins, "begin").otherwise("end"))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two half-open intervals share an instant."""
    return (a_from < b_to) & (b_from < a_to)


def running(rows: DataFrame, by: str, order: list[str], name: str, value: Column, fold: str, inclusive: bool = False) -> DataFrame:
    """rows with name: the fold (max or sum) of value over the rows of the key that come before in order, inclusive: this one too.

    One window per key, unless a key has more than HOT rows: then rows are cut in ranges of key and order, and each range goes on
    from the fold of those before it, so that no task holds a key's rows.
    """
    f = {"max": F.max, "sum": F.sum}[fold]
    span = lambda w: w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    if rows.groupBy(by).count().where(F.col("count") > HOT).isEmpty():
        return rows.withColumn(name, f(value).over(span(W.partitionBy(by))))
    cut = materialize(rows.withColumn("_value", value).repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "running")
    near = f("_value").over(span(W.partitionBy(by, "_range")))
    far = cut.groupBy(by, "_range").agg(f("_value").alias("_all"))
    far = far.withColumn("_far", f("_all").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))  # a row per range
    both = cut.withColumn("_near", near).join(far.select(by, "_range", "_far"), [by, "_range"])
    joined = F.greatest("_near", "_far") if fold == "max" else F.when(F.col("_near").isNotNull() | F.col("_far").isNotNull(), F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0)))
    return both.withColumn(name, joined).select(*rows.columns, name)


def islands(intervals: DataFrame, key: str = "id") -> DataFrame:
    """The gapless unions of each key's intervals, as key, island_from, island_to."""
    order = ["valid_from", "valid_to"]
    rows = running(intervals.select(key, *order), key, order, "reach", F.col("valid_to"), "max")
    opens = F.when(F.col("reach").isNull() | (F.col("valid_from") > F.col("reach")), F.col("valid_from"))
    rows = running(rows.withColumn("opens", opens).drop("reach"), key, order, "island_from", F.col("opens"), "max", inclusive=True)
    return rows.groupBy(key, "island_from").agg(F.max("valid_to").alias("island_to"))


def covered(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges (id, src, dst, valid_from, valid_to) with covered: whether both ends' histories span the edge without a gap."""
    isl = islands(vertices)

    def spans(end: str) -> DataFrame:
        on = (F.col(f"e.{end}") == F.col("i.id")) & (F.col("i.island_from") <= F.col("e.valid_from")) & (F.col("i.island_to") >= F.col("e.valid_to"))
        return edges.alias("e").join(isl.alias("i"), on, "left_semi").select("id", "version")

    good = spans("src").join(spans("dst"), ["id", "version"]).distinct().withColumn("ok", F.lit(True))
    return edges.join(good, ["id", "version"], "left").withColumn("covered", F.coalesce("ok", F.lit(False))).drop("ok")


def overlay(base: DataFrame, staged: DataFrame, valid_at) -> DataFrame:
    """base rows (one per id) with staged puts and deletes on top, in staged order (column ordinal); a delete hides the identity."""
    columns = base.columns
    puts = F.col("tombstone") | ((F.col("valid_from") <= F.lit(valid_at)) & (F.lit(valid_at) < F.col("valid_to")))
    last = staged.where(puts).groupBy("id").agg(F.max_by(F.struct("tombstone", *[c for c in columns if c != "id"]), F.col("ordinal")).alias("w"))
    new = last.where(~F.col("w.tombstone")).select("id", *[F.col(f"w.{c}").alias(c) for c in columns if c != "id"])
    return base.join(last.select("id"), "id", "left_anti").select(*columns).unionByName(new.select(*columns))


def fresh_adjacency(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """An adjacency image (id, src, dst, tx_time, version) with committed deltas (the same and tombstone) applied; a tombstone beats an edge of equal time."""
    rank = F.struct("tx_time", "version", F.col("tombstone"))
    both = base.withColumn("tombstone", F.lit(False)).unionByName(deltas.select(*base.columns, "tombstone"))
    kept = both.groupBy("id").agg(F.max_by(F.struct("src", "dst", "tx_time", "version", "tombstone"), rank).alias("w")).where(~F.col("w.tombstone"))
    return kept.select("id", "w.src", "w.dst", "w.tx_time", "w.version")
