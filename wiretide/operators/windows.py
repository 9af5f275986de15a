"""Sliding-window host aggregates: fan-in per destination and fan-out per source.

Packets are first reduced to panes (the widest slices that tile every window), so each packet is
shuffled once and only pane rows are copied into the windows they belong to. Every later step is an
algebraic aggregate with map-side combining: a flooded host or a scanning source never gathers its
packets in one task.

The totals of all windows shuffle pane rows instead of window rows: panes are dealt by host and block of windows, and
windows are made and summed where the panes lie. Only the blocks of hosts too busy for one task are copied into windows
before they are shuffled and combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.config import SECOND_US, WindowConfig
from wiretide.operators.chain import materialize
from wiretide.schema import PROTOCOLS, half_open, is_probe, normalize_packets

#: Windows in a block, window rows that a task makes of its panes, and hash buckets in which the panes of blocks are counted
BLOCK_WINDOWS = 64
TASK_ROWS = 300_000
COUNT_BUCKETS = 65_536


def pane_counts(packets: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """One row per pane, endpoint pair, destination port and protocol.

    This is the only step that touches packets. It can be written once and read by both views.
    """
    packets = normalize_packets(packets)
    probe = is_probe()
    bounds = packets.agg(F.struct(F.min("ts_us").alias("first"), F.max("ts_us").alias("last")).alias("b")).scalar()
    origin = bounds["first"] if cfg.origin_us is None else F.lit(cfg.origin_us).cast("long")
    return (packets
            .withColumns({"origin_us": origin, "end_us": bounds["last"]})
            .filter(F.col("ts_us") >= F.col("origin_us"))
            .groupBy("origin_us", "end_us",
                     F.floor((F.col("ts_us") - F.col("origin_us")) / F.lit(cfg.pane_us)).alias("pane"),
                     "src_ip", "dst_ip", "dst_port", "protocol")
            .agg(F.count("*").alias("packets"),
                 F.sum("packet_length").cast("long").alias("bytes"),
                 F.count_if(half_open()).alias("syn_only"),
                 F.count_if(probe).alias("probes"),
                 F.min("pkt_id").alias("first_pkt"),
                 F.min(F.when(probe, F.col("pkt_id"))).alias("first_probe"),
                 F.min("ts_us").alias("first_ts_us"),
                 F.max("ts_us").alias("last_ts_us")))


def _windows_of_pane(cfg: WindowConfig) -> tuple[Column, Column]:
    """First and last window that contain a pane; there are none where the first lies behind the last.

    Windows 0..u of the grid are evaluated, where u is the single trailing window that is still open
    when the last packet arrives.
    """
    per_window = cfg.size_us // cfg.pane_us
    per_slide = cfg.slide_us // cfg.pane_us
    past_first = F.col("end_us") - F.col("origin_us") - F.lit(cfg.size_us)
    last = F.when(past_first < 0, F.lit(0).cast("long")).otherwise(F.floor(past_first / F.lit(cfg.slide_us)) + 1)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pane") - F.lit(per_window - 1)) / F.lit(per_slide)))
    return lo, F.least(last, F.floor(F.col("pane") / F.lit(per_slide)))


def _block(rows: DataFrame) -> list[str]:
    """Rows that are dealt by block carry it through every grouping, so that they stay where they lie."""
    return ["block"] if "block" in rows.columns else []


def window_rows(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Pane rows copied into the windows that contain them (of their block, where they have one), with the one-second
    bucket in each."""
    lo, hi = _windows_of_pane(cfg)
    if _block(panes):
        first = F.col("block") * F.lit(BLOCK_WINDOWS)
        lo, hi = F.greatest(lo, first), F.least(hi, first + F.lit(BLOCK_WINDOWS - 1))
    start = F.col("window") * F.lit(cfg.slide_us)
    return (panes.withColumns({"lo": lo, "hi": hi})
            .filter("lo <= hi")
            .withColumn("window", F.explode(F.sequence("lo", "hi")))
            .withColumns({"window_start_us": F.col("origin_us") + start,
                          "second": F.floor((F.col("pane") * F.lit(cfg.pane_us) - start) / F.lit(SECOND_US))}))


def in_blocks(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Pane rows copied into the blocks of windows that need them: one block, two near a border."""
    lo, hi = _windows_of_pane(cfg)
    return (panes.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
            .withColumn("block", F.explode(F.expr(f"sequence(lo div {BLOCK_WINDOWS}, hi div {BLOCK_WINDOWS})"))).drop("lo", "hi"))


def _dealt(panes: DataFrame, host: str, cfg: WindowConfig) -> tuple[DataFrame, DataFrame]:
    """Window rows from panes that are dealt by block and host, and those of blocks in which a host is too busy for that.

    Busy blocks are found by counts per hash bucket, which are few at any size; a block that shares its bucket with a
    busy one counts as busy.
    """
    copies = min(BLOCK_WINDOWS, -(-cfg.size_us // cfg.slide_us))
    rows = in_blocks(panes, cfg).withColumn("bucket", F.pmod(F.xxhash64("block", host), F.lit(COUNT_BUCKETS)))
    counts = rows.groupBy("bucket").agg((F.count("*") * copies).alias("n"))
    busy = materialize(counts.filter(F.col("n") > TASK_ROWS).select("bucket"))
    tasks = max(panes.sparkSession.sparkContext.defaultParallelism, -(-panes.count() * copies // TASK_ROWS))
    calm = rows.join(busy, "bucket", "left_anti").drop("bucket").repartition(tasks, "block", host)
    return window_rows(calm, cfg), window_rows(rows.join(busy, "bucket", "left_semi").drop("bucket"), cfg)


def protocol_parts() -> list[Column]:
    """Packet count and first packet per protocol, over rows that still carry the protocol."""
    parts = []
    for name in PROTOCOLS:
        is_name = F.col("protocol") == name
        parts.append(F.sum(F.when(is_name, F.col("packets")).otherwise(F.lit(0))).alias(f"n_{name}"))
        parts.append(F.min(F.when(is_name, F.col("first_pkt"))).alias(f"first_{name}"))
    return parts


def _sum_where(condition: Column, *names: str) -> list[Column]:
    return [F.sum(F.when(condition, F.col(name)).otherwise(F.lit(0))).alias(name) for name in names]


def _modal_protocol() -> Column:
    """Most frequent protocol; the one seen first wins a tie."""
    ranked = F.array(*[F.struct(F.col(f"n_{name}").alias("n"), (-F.col(f"first_{name}")).alias("first"),
                                F.lit(name).alias("name")) for name in PROTOCOLS])
    return F.array_max(ranked)["name"]


_COUNTS = [f"n_{name}" for name in PROTOCOLS]
_FIRSTS = [f"first_{name}" for name in PROTOCOLS]


def _two_sides(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Every row twice, with only ``one`` (``by_port`` 0) and with only ``other`` (1). Unlike grouping sets this leaves rows
    dealt as they are."""
    return rows.withColumn("by_port", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        one: F.when(F.col("by_port") == 0, F.col(one)), other: F.when(F.col("by_port") == 1, F.col(other))})


def target_facets(rows: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Packets per (window, destination, source) and per (window, destination, port), in one shuffle.

    ``facet`` is ``'source'`` or ``'port'``.
    """
    seconds = [F.sum(F.when(F.col("second") == i, F.col("packets")).otherwise(F.lit(0))).alias(f"second_{i}")
               for i in range(cfg.seconds)]
    sets = _two_sides(rows, "src_ip", "dst_port").groupBy(*_block(rows), "window_start_us", "dst_ip", "src_ip", "dst_port", "by_port")
    return (sets.agg(F.sum("packets").alias("n"), F.sum("bytes").alias("bytes"),
                     F.sum("syn_only").alias("syn_only"), F.min("first_pkt").alias("first_pkt"),
                     F.min("first_ts_us").alias("first_ts_us"), F.max("last_ts_us").alias("last_ts_us"),
                     *seconds, *protocol_parts())
            .withColumn("facet", F.when(F.col("by_port") == 1, F.lit("port")).otherwise(F.lit("source"))).drop("by_port"))


def top_sources(facets: DataFrame, limit: int = 5) -> DataFrame:
    """The busiest sources per (window, destination), most packets first, then first seen.

    The rank limit is applied on both sides of the shuffle, so no group is gathered. Whole facet rows
    pass through, which lets this branch reuse the shuffle of ``target_facets``.
    """
    keys = [*_block(facets), "window_start_us", "dst_ip"]
    order = Window.partitionBy(*keys, "facet").orderBy(F.desc("n"), F.asc("first_pkt"))
    ranked = facets.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    row = F.struct("rank", *[c for c in facets.columns if c not in (*keys, "facet")])
    return (ranked.groupBy(*keys)
            .agg(F.collect_list(F.when(F.col("facet") == "source", row)).alias("ranked"))
            .select(*keys, F.transform(F.array_sort("ranked"), lambda x: x["src_ip"]).alias("top_sources")))


def target_totals(facets: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """All target figures except the list of top sources."""
    source = F.col("facet") == "source"
    seconds = [f"second_{i}" for i in range(cfg.seconds)]
    n = F.col("packets")
    totals = (facets.groupBy(*_block(facets), "window_start_us", "dst_ip")
              .agg(F.sum(F.when(source, F.col("n")).otherwise(F.lit(0))).alias("packets"),
                   *_sum_where(source, "bytes", "syn_only", *seconds, *_COUNTS),
                   F.count_if(source).alias("unique_sources"),
                   F.sum(F.when(source, F.col("n") * F.log2(F.col("n")))).alias("n_log_n"),
                   F.max_by("dst_port", F.when(~source, F.struct(F.col("n"), -F.col("first_pkt")))).alias("top_dst_port"),
                   F.min("first_ts_us").alias("first_ts_us"), F.max("last_ts_us").alias("last_ts_us"),
                   *[F.min(c).alias(c) for c in _FIRSTS]))
    peak = F.greatest(*seconds) if len(seconds) > 1 else F.col(seconds[0])
    return totals.select(
        "window_start_us", (F.col("window_start_us") + F.lit(cfg.size_us)).alias("window_end_us"), "dst_ip",
        "packets", "bytes", peak.alias("peak_pps"), (F.col("syn_only") / n).alias("syn_only_ratio"),
        (F.col("n_UDP") / n).alias("udp_ratio"), "unique_sources",
        F.greatest(F.lit(0.0), F.log2(n.cast("double")) - F.col("n_log_n") / n).alias("source_ip_entropy"),
        "top_dst_port", _modal_protocol().alias("protocol"), "first_ts_us", "last_ts_us")


def all_targets(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """``target_totals`` of every window and destination host, from panes that are written."""
    calm, busy = (target_totals(target_facets(rows, cfg), cfg) for rows in _dealt(panes, "dst_ip", cfg))
    return calm.unionByName(busy)


def fan_in(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Target aggregates: one row per window and destination host."""
    facets = target_facets(window_rows(panes, cfg), cfg)
    return target_totals(facets, cfg).join(top_sources(facets), ["window_start_us", "dst_ip"])


def with_top_sources(targets: DataFrame, panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Add the top sources to a few targets; only their pane rows are shuffled."""
    keys = ["window_start_us", "dst_ip"]
    rows = window_rows(panes, cfg).join(targets.select(*keys), keys, "left_semi")
    return targets.join(top_sources(target_facets(rows, cfg)), keys)


_SOURCE = ["window_start_us", "src_ip"]


def probe_pairs(rows: DataFrame) -> DataFrame:
    """Packets and probes per (window, source, destination, port)."""
    return rows.groupBy(*_block(rows), *_SOURCE, "dst_ip", "dst_port").agg(
        F.sum("packets").alias("packets"), F.sum("probes").alias("probes"), F.min("first_probe").alias("first_probe"),
        F.min("first_ts_us").alias("first_ts_us"), F.max("last_ts_us").alias("last_ts_us"), *protocol_parts())


def source_totals(pairs: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """All source figures except the list of probed ports.

    One grouping of the distinct pairs, taken twice, gives a row per contacted host and a row per port,
    each with its fan-out: distinct probed ports, or distinct probed hosts.
    """
    own = [*_block(pairs), *_SOURCE]
    facets = _two_sides(pairs, "dst_ip", "dst_port").groupBy(*own, "dst_ip", "dst_port", "by_port").agg(
        F.sum("packets").alias("packets"), F.sum("probes").alias("probes"),
        F.count_if(F.col("probes") > 0).alias("fan"), F.min("first_probe").alias("first_probe"),
        F.min("first_ts_us").alias("first_ts_us"), F.max("last_ts_us").alias("last_ts_us"),
        *[F.sum(c).alias(c) for c in _COUNTS], *[F.min(c).alias(c) for c in _FIRSTS])
    host = F.col("by_port") == 0
    # Only probed hosts and ports compete; a null order key never wins max_by. First probed wins a tie.
    order = F.struct(F.col("fan"), -F.col("first_probe"))
    probed = F.col("fan") > 0
    totals = facets.groupBy(*own).agg(
        *_sum_where(host, "packets", "probes", *_COUNTS), F.count_if(host).alias("unique_targets"),
        F.max_by(F.struct("dst_ip", "fan"), F.when(host & probed, order)).alias("v"),
        F.max_by(F.struct("dst_port", "fan"), F.when(~host & probed, order)).alias("h"),
        F.min("first_ts_us").alias("first_ts_us"), F.max("last_ts_us").alias("last_ts_us"),
        *[F.min(c).alias(c) for c in _FIRSTS])
    zero = F.lit(0).cast("long")
    return totals.select(
        "window_start_us", (F.col("window_start_us") + F.lit(cfg.size_us)).alias("window_end_us"), "src_ip",
        "packets", (F.col("probes") / F.col("packets")).alias("probe_ratio"), "unique_targets",
        F.coalesce("v.fan", zero).alias("max_ports_on_one_host"), F.coalesce("v.dst_ip", F.lit("")).alias("vertical_target"),
        F.coalesce("h.fan", zero).alias("max_hosts_on_one_port"), F.coalesce("h.dst_port", F.lit(0)).alias("horizontal_port"),
        _modal_protocol().alias("protocol"), "first_ts_us", "last_ts_us")


def all_sources(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """``source_totals`` of every window and source host, from panes that are written."""
    calm, busy = (source_totals(probe_pairs(rows), cfg) for rows in _dealt(panes, "src_ip", cfg))
    return calm.unionByName(busy)


def pairs_of(sources: DataFrame, panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """``probe_pairs`` of a few sources; only their pane rows are shuffled."""
    return probe_pairs(window_rows(panes, cfg).join(sources.select(*_SOURCE), _SOURCE, "left_semi"))


def with_probed_ports(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the sorted ports probed on the vertical target, at most 65,536 of them."""
    wanted = sources.select(*_SOURCE, F.col("vertical_target").alias("dst_ip"))
    ports = (pairs.filter("probes > 0").join(wanted, [*_SOURCE, "dst_ip"], "left_semi")
             .groupBy(*_SOURCE).agg(F.array_sort(F.collect_list("dst_port")).alias("probed_ports")))
    return (sources.join(ports, _SOURCE, "left")
            .withColumn("probed_ports", F.coalesce("probed_ports", F.array().cast("array<int>"))))


def fan_out(panes: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Source aggregates: one row per window and source host."""
    pairs = probe_pairs(window_rows(panes, cfg))
    return with_probed_ports(source_totals(pairs, cfg), pairs)


_TARGET_ZEROS = {"packets": 0, "peak_pps": 0, "syn_only_ratio": 0.0, "udp_ratio": 0.0, "unique_sources": 0,
                 "source_ip_entropy": 0.0}
_SOURCE_ZEROS = {"packets": 0, "probe_ratio": 0.0, "max_ports_on_one_host": 0, "max_hosts_on_one_port": 0,
                 "unique_targets": 0}


def hosts(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Every host of a window, as target, as source or both; the missing side counts as zeros."""
    t = targets.select("window_start_us", "window_end_us", F.col("dst_ip").alias("host"), F.lit(True).alias("is_target"),
                       *[F.col(c).alias(f"in_{c}") for c in _TARGET_ZEROS])
    s = sources.select("window_start_us", "window_end_us", F.col("src_ip").alias("host"), F.lit(True).alias("is_source"),
                       *[F.col(c).alias(f"out_{c}") for c in _SOURCE_ZEROS])
    joined = t.join(s, ["window_start_us", "window_end_us", "host"], "full_outer")
    zeros = ({f"in_{c}": v for c, v in _TARGET_ZEROS.items()} | {f"out_{c}": v for c, v in _SOURCE_ZEROS.items()}
             | {"is_target": False, "is_source": False})
    return joined.fillna(zeros)


def candidate_hosts(host_rows: DataFrame, min_packets: int = 50, min_fan_out: int = 5) -> DataFrame:
    """Busy receivers and active probers: the only hosts worth scoring with a model."""
    return host_rows.filter((F.col("in_packets") >= min_packets) | (F.col("out_max_ports_on_one_host") >= min_fan_out)
                            | (F.col("out_max_hosts_on_one_port") >= min_fan_out))
