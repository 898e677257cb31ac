"""Frame synchronisation, quorum, streaming statistics and multiplexing over arrivals, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def completeness(arrivals: DataFrame, cameras: int) -> DataFrame:
    """Distinct cameras, first and last arrival of each frame, and whether all came."""
    return arrivals.groupBy("frame_id").agg(
        F.count_distinct("worker_id").alias("cameras"), F.count("*").alias("arrivals"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms")
    ).withColumn("complete", F.col("cameras") == cameras)


def quorum(arrivals: DataFrame, k: int) -> DataFrame:
    """When each frame's k-th distinct worker came; frames without a quorum are not released."""
    first = arrivals.groupBy("frame_id", "worker_id").agg(F.min(F.struct("timestamp_ms", "event_id")).alias("a"))
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("a"))
    return first.withColumn("r", rank).where(F.col("r") == k).select("frame_id", F.col("a.timestamp_ms").alias("released_ms"))


def late(arrivals: DataFrame, k: int) -> DataFrame:
    """First partials of workers that came after their frame's release."""
    first = arrivals.groupBy("frame_id", "worker_id").agg(F.min(F.struct("timestamp_ms", "event_id")).alias("a"))
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("a"))
    return first.withColumn("r", rank).where(F.col("r") > k).select("frame_id", "worker_id", F.col("a.timestamp_ms").alias("timestamp_ms"))


def miss_streaks(arrivals: DataFrame, threshold: int) -> DataFrame:
    """Runs of at least so many frames in a row that a worker missed: gaps between the ranks of the frames that it has, and before the
    first and after the last of them. Work grows with the arrivals, not with frames times workers."""
    seen = arrivals.select("frame_id", "worker_id").distinct()
    frames = numbered(seen.select("frame_id").distinct(), "frame_id", "n")
    ends = frames.agg(F.max("n").alias("_last"))
    w = Window.partitionBy("worker_id").orderBy("n")
    own = seen.join(frames, "frame_id").select("worker_id", "n").crossJoin(F.broadcast(ends))  # one row
    last = F.coalesce(F.lead("n").over(w), F.col("_last") + 1)
    own = own.withColumns({"_to": last, "_first": F.lag("n").over(w).isNull()})
    after = own.select("worker_id", (F.col("n") + 1).alias("n"), (F.col("_to") - F.col("n") - 1).alias("misses"))
    before = own.where("_first").select("worker_id", F.lit(0).cast("long").alias("n"), F.col("n").alias("misses"))
    gaps = after.unionByName(before).where((F.col("misses") > 0) & (F.col("misses") >= threshold))
    names = frames.select(F.col("n").alias("_n"), F.col("frame_id").alias("from_frame"))
    return gaps.join(names, F.col("n") == F.col("_n")).select("worker_id", "from_frame", "misses")


def by_range(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of an order, with the range's number (_part). Persisted, so that all who read it see the same ranges: these come from
    a sample."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).persist()


def numbered(rows: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """Row numbers from 0 in an order over all rows: ranges of the order, counted, with the counts before them added. No task holds more
    than a range. The order must tell all rows apart."""
    order = [order] if isinstance(order, str) else order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count a partition's rows: no window, no further exchange
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": place}).persist()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(before), "_part").withColumn(out, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def _blocks(rows: DataFrame, window_ms: int, least: int = 64) -> DataFrame:
    """Rows with the block of time that they are in (_block, _own true), and again in the next block where its windows reach back to them
    (_own false). Windows of a stream can then be partitioned by block too."""
    span = least * max(1, window_ms)
    b = F.floor(F.col("timestamp_ms") / span)
    again = F.when(F.col("timestamp_ms") >= (b + 1) * span - window_ms, F.struct((b + 1).alias("_block"), F.lit(False).alias("_own")))
    return rows.withColumn("_b", F.array_compact(F.array(F.struct(b.alias("_block"), F.lit(True).alias("_own")), again))).select(*rows.columns, F.inline("_b"))


def evicted(arrivals: DataFrame, cameras: int, pending: int) -> DataFrame:
    """Incomplete frames below the newest so many, with the arrivals that go with them."""
    done = completeness(arrivals, cameras).where("NOT complete")
    newest = done.orderBy(F.desc("frame_id")).limit(pending).agg(F.min("frame_id").alias("least"))
    return done.join(F.broadcast(newest), F.col("frame_id") < F.col("least")).select("frame_id", F.col("arrivals").alias("dropped"))


def _upto(back: int):
    """The window of a block's rows up to so long before each: it only grows from row to row, so that a block takes one pass however many
    rows a trailing window holds. What a trailing window holds is the difference of two such."""
    return Window.partitionBy("worker_id", "_block").orderBy("timestamp_ms").rangeBetween(Window.unboundedPreceding, -back)


def _trailing(value, window_ms: int):
    """Sum of whole numbers, not null, over the trailing window; rows without a time form a window of their own."""
    before = F.when(F.col("timestamp_ms").isNotNull(), F.coalesce(F.sum(value).over(_upto(window_ms + 1)), F.lit(0)))
    return F.sum(value).over(_upto(0)) - F.coalesce(before, F.lit(0))


def bitrate(packets: DataFrame, window_ms: int = 2000) -> DataFrame:
    """Bits a second over the trailing window of each stream; null before there are two packets and a span."""
    following = F.lead("timestamp_ms").over(Window.partitionBy("worker_id", "_block").orderBy("timestamp_ms"))
    rows = _blocks(packets, window_ms).withColumn("_following", following)
    first = F.coalesce(F.max("_following").over(_upto(window_ms + 1)), F.min("timestamp_ms").over(_upto(0)))  # the one after the last that is too old
    rows = rows.withColumns({"_n": _trailing(F.lit(1), window_ms), "_sum": _trailing(F.coalesce("bytes", F.lit(0)), window_ms), "_known": _trailing(F.col("bytes").isNotNull().cast("int"), window_ms), "_span": F.col("timestamp_ms") - first})
    out = rows.withColumn("bps", F.when((F.col("_n") >= 2) & (F.col("_span") > 0) & (F.col("_known") > 0), F.col("_sum") * 8 * 1000 / F.col("_span")))
    return out.where("_own").drop("_block", "_own", "_following", "_n", "_sum", "_known", "_span")


def trailing_count(arrivals: DataFrame, window_ms: int) -> DataFrame:
    return _blocks(arrivals, window_ms).withColumn("frames", _trailing(F.lit(1), window_ms)).where("_own").drop("_block", "_own")


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, block: int = 1 << 22) -> DataFrame:
    """Exponential mean from 0 over the ordered values of each key. Blocks of the first order column are folded on their own to what they
    add and by what they shrink the mean before them; these pairs are folded in turn."""
    kept = F.col(value).cast("double")
    parts = rows.groupBy(key, F.floor(F.col(order[0]) / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(*order, kept.alias("_v")))).alias("vs"), F.count("*").alias("n"))
    parts = parts.select(key, "_block", "n", F.aggregate("vs", F.lit(0.0), lambda s, x: s * (1 - alpha) + x["_v"] * alpha).alias("add"), F.pow(F.lit(1 - alpha), "n").alias("keep"))
    held = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "keep", "add"))).alias("ps"), F.sum("n").alias("n"))
    return held.select(key, "n", F.aggregate("ps", F.lit(0.0), lambda s, p: s * p["keep"] + p["add"]).alias("ema"))


def gop(frames: DataFrame, interval: int, order: str, partition: str) -> DataFrame:
    """Group of pictures, place in it, and whether the row is its keyframe, every so many rows."""
    at = F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1
    return frames.withColumn("gop", F.floor(at / interval)).withColumn("place", (at % interval).cast("long")).withColumn("keyframe", F.col("place") == 0)


def carried(rows: DataFrame, key: str, order: list[str], value, out: str, block, ahead: bool = False) -> DataFrame:
    """The last value that is not null up to each row of its key in an order, or with ahead the first from it on. block: a column that
    grows with the order; windows run within a block, and what blocks hand on is a row each."""
    way = [F.desc(c) if ahead else F.asc(c) for c in order]
    w = Window.partitionBy(key, "_block").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumns({"_block": block, "_value": value})
    place = F.struct(*order)
    ends = held.where("_value IS NOT NULL").groupBy(key, "_block").agg((F.min_by if ahead else F.max_by)("_value", place).alias("_end"))
    across = Window.partitionBy(key).orderBy(F.desc("_block") if ahead else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.select(key, "_block").distinct().join(ends, [key, "_block"], "left").withColumn("_handed", F.last("_end", ignorenulls=True).over(across)).drop("_end")
    found = held.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).join(blocks, [key, "_block"], "left")
    return found.withColumn(out, F.coalesce("_found", "_handed")).drop("_block", "_value", "_found", "_handed")


def last_keyframe(packets: DataFrame, block_ms: int = 1 << 26) -> DataFrame:
    """The newest keyframe of the stream at every packet."""
    key = F.when(F.col("type") == "keyframe", F.col("event_id"))
    return carried(packets, "worker_id", ["timestamp_ms", "event_id"], key, "keyframe_id", F.floor(F.col("timestamp_ms") / block_ms))


def hold_and_release(packets: DataFrame, hold_ms: int, block: int = 1024) -> DataFrame:
    """Video packets held until geometry of the same or a later frame comes in their stream: which, and whether the hold expired. The
    geometry of each frame is summed first; only a row for each stream and frame takes part in the search."""
    came = F.min(F.when(F.col("type") != "video", F.col("timestamp_ms"))).alias("ms")
    frames = packets.groupBy("worker_id", "frame_id").agg(came)
    geometry = F.when(F.col("ms").isNotNull(), F.struct("frame_id", F.col("ms").alias("timestamp_ms")))
    frames = carried(frames, "worker_id", ["frame_id"], geometry, "g", F.floor(F.col("frame_id") / block), ahead=True).select("worker_id", "frame_id", "g")
    out = packets.where("type = 'video'").join(frames, ["worker_id", "frame_id"], "left")
    wait = F.greatest(F.lit(0), F.col("g.timestamp_ms") - F.col("timestamp_ms"))
    return out.select("event_id", "worker_id", "frame_id", F.col("g.frame_id").alias("released_by"), wait.alias("wait_ms"), F.coalesce(wait > hold_ms, F.lit(True)).alias("expired"))


def queue_actions(packets: DataFrame, high: int = 30, critical: int = 60, window_ms: int = 2000, video_tracks: int = 1) -> DataFrame:
    """Rows at which a stream is told to act on the depth of its queue, the packets of the trailing window: from the high mark on to drop
    deltas, from the critical one on to skip video, or to send fewer splats where there are no video tracks. An action is told when it is
    not the one before; that the queue has drained is not told, but the next action is told again after it."""
    worst = "skip_video" if video_tracks > 0 else "reduce_splats"
    action = F.when(F.col("depth") >= critical, worst).when(F.col("depth") >= high, "drop_delta").otherwise("none")
    out = _blocks(packets, window_ms).withColumn("depth", _trailing(F.lit(1), window_ms)).where("_own").withColumn("action", action)
    # the row before: in the block, or the last one of the block with rows before it
    s = Window.partitionBy("worker_id", "_block").orderBy("timestamp_ms", "event_id")
    ends = out.groupBy("worker_id", "_block").agg(F.max_by("action", F.struct("timestamp_ms", "event_id")).alias("_end"))
    ends = ends.withColumn("_handed", F.lag("_end").over(Window.partitionBy("worker_id").orderBy("_block"))).drop("_end")
    out = out.withColumn("_before", F.lag("action").over(s)).join(ends, ["worker_id", "_block"])
    told = (F.col("action") != "none") & (F.col("action") != F.coalesce("_before", "_handed", F.lit("none")))
    return out.where(told).drop("_block", "_own", "_before", "_handed")


def adapted(packets: DataFrame, critical: int = 60, window_ms: int = 2000) -> DataFrame:
    """Packets with the queue depth that they meet and whether they are sent: empty ones are no packets, and deltas go from the critical
    mark on; keyframes and video pass (what the stream is told is queue_actions())."""
    out = _blocks(packets.where("bytes > 0"), window_ms).withColumn("depth", _trailing(F.lit(1), window_ms)).where("_own").drop("_block", "_own")
    return out.withColumn("sent", ~((F.col("type") == "delta") & (F.col("depth") >= critical)))


def mux_places(packets: DataFrame, block: int = 1024) -> DataFrame:
    """Sending order of each stream: by frame, geometry before video, then time. Ranks run within blocks of frames; the counts of the blocks
    before are added."""
    b = F.floor(F.col("frame_id") / block)
    rows = packets.withColumn("_block", b)
    before = rows.groupBy("worker_id", "_block").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("worker_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("worker_id", "_block").orderBy("frame_id", (F.col("type") == "video").cast("int"), "timestamp_ms", "event_id")
    return rows.withColumn("_at", F.row_number().over(w)).join(before, ["worker_id", "_block"]).withColumn("place", (F.col("_at") + F.col("_before")).cast("long")).drop("_block", "_at", "_before")


def counters(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each stream by type."""
    kinds = ("video", "keyframe", "delta")
    return packets.groupBy("worker_id").agg(*[F.count_if(F.col("type") == k).alias(f"{k}s") for k in kinds], F.sum("bytes").alias("bytes"))
