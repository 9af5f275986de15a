import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import T0
from wiretide.config import DetectionConfig, WindowConfig
from wiretide.operators.detection import source_detections, target_detections
from wiretide.operators.detectors import built_in
from wiretide.operators import windows
from wiretide.operators.chain import materialize
from wiretide.operators.windows import (
    all_sources, all_targets, candidate_hosts, fan_in, fan_out, hosts, pairs_of, pane_counts, probe_pairs, source_totals, target_facets,
    target_totals, window_rows, with_probed_ports)

S = 1_000_000


def starts(df):
    return [(r.window_start_us - T0) / S for r in df.select("window_start_us").distinct().orderBy("window_start_us").collect()]


def test_window_contents_and_grid(make_packets):
    targets = fan_in(pane_counts(make_packets([{"t": t} for t in (10.2, 11.7, 12.9, 13.1, 15.0)])))
    got = {round((r.window_start_us - T0) / S, 3): r.packets for r in targets.collect()}
    # The window from 12.2 is the one still open at the last packet; none starts later
    assert got == {10.2: 4, 11.2: 3, 12.2: 3}


def test_silence_is_skipped(make_packets):
    targets = fan_in(pane_counts(make_packets([{"t": t} for t in (0.5, 90.0, 90.25)])))
    assert {(r.window_start_us - T0) / S: r.packets for r in targets.collect()} == {0.5: 1, 87.5: 2}


def test_tumbling_and_slower_slides(make_packets):
    packets = make_packets([{"t": 0.5 * i} for i in range(20)])
    for size, slide in ((3, 3), (2, 1), (1, 2), (5, 2)):
        cfg = WindowConfig(size_us=size * S, slide_us=slide * S)
        last = 9.5
        u = 0 if last < size else math.floor((last - size) / slide) + 1
        want = {k * slide: sum(1 for i in range(20) if k * slide <= 0.5 * i < k * slide + size) for k in range(u + 1)}
        got = {(r.window_start_us - T0) / S: r.packets for r in fan_in(pane_counts(packets, cfg), cfg).collect()}
        assert got == {k: n for k, n in want.items() if n}, (size, slide)


def brute(rows):
    """Target and source aggregates of the first window, by direct counting in arrival order."""
    rows = [r for r in sorted(rows, key=lambda r: r["pkt_id"]) if r["t"] < 3.0]
    out_t, out_s = {}, {}
    for dst in {r["dst_ip"] for r in rows}:
        mine = [r for r in rows if r["dst_ip"] == dst]
        n, sources = len(mine), Counter(r["src_ip"] for r in mine)
        out_t[dst] = (n, max(Counter(int(r["t"]) for r in mine).values()), len(sources),
                      round(-sum(c / n * math.log2(c / n) for c in sources.values()), 6), [s for s, _ in sources.most_common(5)],
                      Counter(r["dst_port"] for r in mine).most_common(1)[0][0], Counter(r["protocol"] for r in mine).most_common(1)[0][0])
    for src in {r["src_ip"] for r in rows}:
        mine = [r for r in rows if r["src_ip"] == src]
        probes = [r for r in mine if (r["syn"] and not r["ack"] if r["protocol"] == "TCP" else r["payload_length"] == 0 if r["protocol"] == "UDP"
                                      else r["protocol"] == "ICMP")]
        ports, reach = {}, {}
        for r in probes:
            ports.setdefault(r["dst_ip"], set()).add(r["dst_port"])
            reach.setdefault(r["dst_port"], set()).add(r["dst_ip"])
        v = max(ports.items(), key=lambda kv: len(kv[1]), default=("", set()))
        h = max(reach.items(), key=lambda kv: len(kv[1]), default=(0, set()))
        out_s[src] = (len(mine), len(probes) / len(mine), len({r["dst_ip"] for r in mine}), len(v[1]), v[0], sorted(v[1]), len(h[1]), h[0],
                      Counter(r["protocol"] for r in mine).most_common(1)[0][0])
    return out_t, out_s


def test_aggregates_match_direct_counting_in_any_row_order(make_packets):
    rng = random.Random(5)
    rows = [{"pkt_id": i, "t": round(i * 0.01, 6), "src_ip": f"10.0.0.{rng.randint(1, 9)}", "dst_ip": f"10.1.0.{rng.randint(1, 4)}",
             "dst_port": rng.randint(1, 6), "protocol": rng.choice(["TCP", "UDP", "ICMP", "OTHER"]), "payload_length": rng.choice([0, 10]),
             "syn": rng.random() < 0.6, "ack": rng.random() < 0.3} for i in range(400)]
    want_t, want_s = brute(rows)
    for partitions in (1, 5):
        rng.shuffle(rows)
        panes = pane_counts(make_packets([dict(r) for r in rows]).repartition(partitions))
        first = F.col("window_start_us") == T0
        got_t = {r.dst_ip: (r.packets, r.peak_pps, r.unique_sources, round(r.source_ip_entropy, 6), r.top_sources, r.top_dst_port, r.protocol)
                 for r in fan_in(panes).filter(first).collect()}
        got_s = {r.src_ip: (r.packets, r.probe_ratio, r.unique_targets, r.max_ports_on_one_host, r.vertical_target, r.probed_ports,
                            r.max_hosts_on_one_port, r.horizontal_port, r.protocol) for r in fan_out(panes).filter(first).collect()}
        assert got_t == want_t and got_s == want_s


def _alerts(packets):
    rules, panes = built_in(DetectionConfig()), pane_counts(packets)
    return target_detections(fan_in(panes), rules).collect(), source_detections(fan_out(panes), rules).collect()


def test_syn_flood(make_packets):
    floods, scans = _alerts(make_packets([{"t": i * 0.002, "src_ip": f"198.51.100.{i % 200}", "dst_ip": "10.0.0.80", "dst_port": 80,
                                           "syn": True, "ack": False} for i in range(600)]))
    assert floods and not scans
    assert max(a.confidence_score for a in floods) >= 0.90
    assert {a.dedup_key for a in floods} == {"*->10.0.0.80"} and all('"indicators":["' in a.evidence for a in floods)


def test_busy_server_is_no_flood(make_packets):
    floods, scans = _alerts(make_packets([{"t": i * 0.002, "src_ip": f"198.51.100.{i % 50}", "dst_ip": "10.0.0.80", "psh": True} for i in range(600)]))
    assert not floods and not scans


def test_vertical_and_horizontal_scan(make_packets):
    probe = {"syn": True, "ack": False, "payload_length": 0, "src_ip": "10.0.0.66"}
    _, scans = _alerts(make_packets([{**probe, "t": i * 0.1, "dst_ip": "10.0.0.5", "dst_port": 20 + i} for i in range(13)]))
    best = max(scans, key=lambda a: a.confidence_score)
    assert best.confidence_score == 0.8 and best.flow_id == "10.0.0.66:*->10.0.0.5:*_TCP" and '"distinct_ports_on_one_host":13' in best.evidence
    _, scans = _alerts(make_packets([{**probe, "t": i * 0.1, "dst_ip": f"10.0.1.{i}", "dst_port": 445} for i in range(25)]))
    assert {a.flow_id for a in scans} == {"10.0.0.66:*->*:445_TCP"}


def test_hosts_and_candidates(make_packets):
    panes = pane_counts(make_packets([{"t": i * 0.01, "dst_ip": "10.0.0.9"} for i in range(60)]))
    rows = {r.host: r for r in hosts(fan_in(panes), fan_out(panes)).collect()}
    assert rows["10.0.0.9"].in_packets == 60 and rows["10.0.0.9"].out_packets == 0 and not rows["10.0.0.9"].is_source
    assert [r.host for r in candidate_hosts(hosts(fan_in(panes), fan_out(panes))).collect()] == ["10.0.0.9"]


def test_pane_shuffle_is_reused(make_packets):
    """Both fan-in branches read one shuffle of facet rows."""
    plan = fan_in(pane_counts(make_packets([{"t": i * 0.1} for i in range(30)])))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text


def _plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("limit, size, slide", [(windows.TASK_ROWS, 3, 1), (120, 5, 2), (1, 3, 1)])
def test_totals_of_blocks_equal_those_of_shuffled_windows(make_packets, monkeypatch, limit, size, slide):
    """Over several blocks of windows, with hosts that are busy in none, some or all of them."""
    rng = random.Random(8)
    rows = [{"pkt_id": i, "t": round(rng.random() * (8 if i % 2 else 200), 6), "src_ip": f"10.0.0.{rng.randint(1, 5)}",
             "dst_ip": rng.choice(["10.1.0.1", "10.1.0.2"]), "dst_port": rng.randint(1, 4), "protocol": rng.choice(["TCP", "UDP"]),
             "payload_length": rng.choice([0, 10]), "syn": rng.random() < 0.6, "ack": rng.random() < 0.3} for i in range(400)]
    packets = make_packets(rows)
    monkeypatch.setattr(windows, "TASK_ROWS", limit)
    cfg = WindowConfig(size_us=size * S, slide_us=slide * S)
    panes = materialize(pane_counts(packets, cfg))
    whole = window_rows(panes, cfg)
    targets, sources, pairs = target_totals(target_facets(whole, cfg), cfg), source_totals(probe_pairs(whole), cfg), probe_pairs(whole)
    assert _plain(all_targets(panes, cfg)) == _plain(targets) and _plain(all_sources(panes, cfg)) == _plain(sources)
    few = materialize(sources.filter("packets > 3"))
    assert _plain(with_probed_ports(few, pairs_of(few, panes, cfg))) == _plain(with_probed_ports(few, pairs))


def test_totals_shuffle_panes_and_not_windows(make_packets):
    """Panes are dealt once; neither their copies in windows nor what these are summed to is shuffled."""
    panes = materialize(pane_counts(make_packets([{"t": i * 0.5} for i in range(300)])))
    for host, totals in (("dst_ip", lambda rows: target_totals(target_facets(rows))), ("src_ip", lambda rows: source_totals(probe_pairs(rows)))):
        text = totals(windows._dealt(panes, host, WindowConfig())[0])._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(block#" in text
