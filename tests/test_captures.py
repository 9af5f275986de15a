import random

import pytest

from helpers import ipv4, pcap, pcapng, tcp, udp
from wiretide.sources.packets import capped
from wiretide.sources.captures import capture_statistics, chunk_index, read_captures, read_frames

ETHERNET = b"\0" * 12 + b"\x08\x00"
SYN = ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 0x02))
DNS = ipv4("10.0.0.1", "8.8.8.8", 17, udp(5000, 53, b"hello"))
T = 1_700_000_000_250_000


def read(spark, folder, **options):
    return read_captures(spark, str(folder), **options).orderBy("pkt_id").collect()


def test_ethernet(spark, tmp_path):
    vlan = b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00"
    arp = b"\0" * 12 + b"\x08\x06" + bytes(28)
    (tmp_path / "a.pcap").write_bytes(pcap([(T, ETHERNET + SYN + b"pad"), (T + 1, arp), (T + 2, vlan + DNS)]))
    first, second = read(spark, tmp_path)
    assert (first.ts_us, first.src_ip, first.dst_ip, first.src_port, first.dst_port, first.protocol) == (T, "10.0.0.1", "10.0.0.2", 1234, 80, "TCP")
    # Padding behind the IP packet counts as captured, not as payload
    assert (first.packet_length, first.payload_length, first.syn, first.ack) == (57, 0, True, False)
    assert (second.frame, second.protocol, second.payload_length, bytes(second.raw_payload)) == (3, "UDP", 5, b"hello")


@pytest.mark.parametrize("linktype, head", [(101, b""), (113, bytes(14) + b"\x08\x00"), (276, b"\x08\x00" + bytes(18)), (0, b"\x02\0\0\0"), (12, b"")])
def test_link_types(spark, tmp_path, linktype, head):
    (tmp_path / "a.pcap").write_bytes(pcap([(T, head + SYN)], linktype))
    row, = read(spark, tmp_path)
    assert (row.protocol, row.dst_port, row.packet_length) == ("TCP", 80, len(head + SYN))


@pytest.mark.parametrize("order, magic", [("<", 0xA1B2C3D4), (">", 0xA1B2C3D4), ("<", 0xA1B23C4D)])
def test_byte_orders_and_nanoseconds(spark, tmp_path, order, magic):
    (tmp_path / "a.pcap").write_bytes(pcap([(T, ETHERNET + SYN)], order=order, magic=magic))
    assert [r.ts_us for r in read(spark, tmp_path)] == [T]


def test_pcapng(spark, tmp_path):
    (tmp_path / "a.pcapng").write_bytes(pcapng([(T, SYN), (T + 7, DNS)]))
    assert [(r.ts_us, r.protocol) for r in read(spark, tmp_path)] == [(T, "TCP"), (T + 7, "UDP")]


def test_other_protocols_v6_and_fragments(spark, tmp_path):
    v6 = bytes.fromhex("60000000") + (28).to_bytes(2, "big") + b"\x00\x40" + bytes(15) + b"\x01" + bytes(15) + b"\x02" + b"\x11\x00" + bytes(6) + udp(1, 2)
    v6 = v6[:4] + len(v6[40:]).to_bytes(2, "big") + v6[6:]
    ping = ipv4("1.1.1.1", "2.2.2.2", 1, b"\x08\x00\x00\x00")
    fragment = bytearray(SYN)
    fragment[7] = 9
    (tmp_path / "a.pcap").write_bytes(pcap([(T, v6), (T, ping), (T, bytes(fragment)), (T, ipv4("1.1.1.1", "2.2.2.2", 47, b"gre"))], 101))
    rows = read(spark, tmp_path)
    assert [(r.protocol, r.src_port) for r in rows] == [("UDP", 1), ("ICMP", 0), ("OTHER", 0), ("OTHER", 0)] and rows[0].src_ip == "::1"


def test_cut_file_and_statistics(spark, tmp_path):
    frames = [(T + i, ETHERNET + SYN) for i in range(13)]
    (tmp_path / "cut.pcap").write_bytes(pcap(frames)[:-60])
    (tmp_path / "ok.pcap").write_bytes(pcap([(T, b"\0" * 20)] + frames))
    (tmp_path / "junk.pcap").write_bytes(b"no capture")
    chunks = chunk_index(spark, str(tmp_path))
    stats = {r.path.rsplit("/", 1)[1]: r for r in capture_statistics(chunks, read_frames(chunks), 12).collect()}
    assert (stats["cut.pcap"].packets_parsed, stats["cut.pcap"].cut_short, stats["cut.pcap"].truncated) == (12, True, False)
    assert (stats["ok.pcap"].frames_read, stats["ok.pcap"].packets_parsed) == (stats["ok.pcap"].frames_skipped + 12, 12)
    assert stats["ok.pcap"].truncated and stats["ok.pcap"].packets_used == 12 and not stats["ok.pcap"].cut_short
    whole = {r.path.rsplit("/", 1)[1]: r for r in capture_statistics(chunks, read_frames(chunks)).collect()}
    assert (whole["ok.pcap"].frames_read, whole["ok.pcap"].packets_parsed, whole["ok.pcap"].frames_skipped, whole["ok.pcap"].truncated) == (14, 13, 1, False)
    none = {r.path.rsplit("/", 1)[1]: r for r in capture_statistics(chunks, read_frames(chunks), 0).collect()}
    assert (none["ok.pcap"].frames_read, none["ok.pcap"].truncated, none["junk.pcap"].truncated) == (0, True, False)
    assert (stats["junk.pcap"].format, stats["junk.pcap"].frames_read) == ("unknown", 0)


def test_chunking_does_not_change_the_packets(spark, tmp_path):
    for name, data in (("a.pcap", pcap([(T + i, ETHERNET + (SYN if i % 3 else DNS)) for i in range(200)])),
                       ("b.pcapng", pcapng([(T + i, SYN if i % 2 else DNS) for i in range(150)]))):
        (tmp_path / name).write_bytes(data)
    whole, parts = read(spark, tmp_path), read(spark, tmp_path, chunk_bytes=500)
    assert len(whole) == 350 and whole == parts and len({r.pkt_id for r in whole}) == 350
    assert chunk_index(spark, str(tmp_path), chunk_bytes=500).count() > 20


def sequential(path, chunk_bytes):
    """(offset, length, first frame) of the chunks of a little-endian pcap file, by one walk."""
    data, at, frame, chunks = path.read_bytes(), 24, 1, {}
    while at + 16 <= len(data):
        size = 16 + int.from_bytes(data[at + 8:at + 12], "little")
        first, length, n = chunks.get(at // chunk_bytes, (at, 0, frame))
        chunks[at // chunk_bytes] = (first, length + min(size, len(data) - at), n)
        at, frame = at + size, frame + 1
    return sorted(chunks.values())


def index(spark, folder, chunk_bytes, segment_chunks):
    rows = chunk_index(spark, str(folder), chunk_bytes=chunk_bytes, segment_chunks=segment_chunks).filter("length > 0").collect()
    return sorted((r.offset, r.length, r.first_frame) for r in rows)


@pytest.mark.parametrize("segment_chunks", [1, 3, 1000])
def test_segments_walk_what_one_walk_does(spark, tmp_path, segment_chunks):
    rng = random.Random(1)
    inner = pcap([(T + i, SYN) for i in range(30)])  # a capture inside a packet: borders that only look like some
    frames = [(T + 1000 * i, ETHERNET + SYN + rng.randbytes(rng.choice([0, 0, 3, 400]))) for i in range(400)]
    frames[100:100] = [(T, ETHERNET + DNS + inner), (T, ETHERNET + bytes(3000)), (T, inner * 3)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    want = sequential(tmp_path / "a.pcap", 700)
    assert index(spark, tmp_path, 700, segment_chunks) == want and len(want) > 50
    assert [r.frame for r in read(spark, tmp_path, chunk_bytes=700)] == [i + 1 for i, (_, f) in enumerate(frames) if f.startswith(ETHERNET) and any(f[14:])]


def test_segments_of_pcapng_and_odd_clocks(spark, tmp_path):
    (tmp_path / "a.pcapng").write_bytes(pcapng([(T + i, SYN if i % 2 else DNS + bytes(i)) for i in range(200)]))
    assert index(spark, tmp_path, 600, 2) == index(spark, tmp_path, 600, 1000)
    (tmp_path / "a.pcapng").unlink()
    # Times far from the first record's defeat the guess, not the walk; so does a record longer than a segment
    (tmp_path / "b.pcap").write_bytes(pcap([(T if i == 0 else 0, SYN + bytes(9000 if i == 40 else 0)) for i in range(80)])[:-5])
    assert index(spark, tmp_path, 500, 2) == sequential(tmp_path / "b.pcap", 500)


def test_a_cap_counts_packets_only(spark, tmp_path):
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 28
    (tmp_path / "a.pcap").write_bytes(pcap([(T + i, arp) for i in range(5)] + [(T + 5 + i, ETHERNET + SYN) for i in range(10)]))
    assert capped(read_captures(spark, str(tmp_path)), 8).count() == 8
    row = capture_statistics(chunks := chunk_index(spark, str(tmp_path)), read_frames(chunks), 8).first()
    assert (row.frames_read, row.packets_parsed, row.frames_skipped, row.truncated) == (13, 8, 5, True)
