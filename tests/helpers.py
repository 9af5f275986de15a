"""Byte builders for payload tests and the time at which test packets start."""

import struct

T0 = 1_700_000_000_000_000


def _sized(width, data):
    return len(data).to_bytes(width, "big") + data


def client_hello(ciphers, sni="", groups=None, formats=None, extra=(), version=0x0303):
    parts = []
    if sni:
        parts.append((0, _sized(2, b"\0" + _sized(2, sni.encode()))))
    if groups is not None:
        parts.append((10, _sized(2, b"".join(struct.pack("!H", g) for g in groups))))
    if formats is not None:
        parts.append((11, _sized(1, bytes(formats))))
    parts += [(kind, b"") for kind in extra]
    extensions = b"".join(struct.pack("!H", kind) + _sized(2, data) for kind, data in parts)
    body = struct.pack("!H", version) + bytes(33) + _sized(2, b"".join(struct.pack("!H", c) for c in ciphers)) + b"\x01\x00"
    if parts:
        body += _sized(2, extensions)
    return b"\x16\x03\x01" + _sized(2, b"\x01" + _sized(3, body))


def dns_query(name, kind=1):
    labels = b"".join(_sized(1, part.encode()) for part in name.split("."))
    return bytes.fromhex("abcd01000001000000000000") + labels + b"\0" + struct.pack("!HH", kind, 1)


def ipv4(src, dst, number, body):
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def tcp(sport, dport, flags, payload=b""):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload


def pcap(frames, linktype=1, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for ts, data in frames:
        seconds, part = divmod(ts, 1_000_000)
        if magic == 0xA1B23C4D:
            part *= 1000
        out += struct.pack(order + "IIII", seconds, part, len(data), len(data)) + data
    return out


def pcapng(frames, linktype=101):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        size = 12 + len(body)
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", linktype, 0, 0))
    for ts, data in frames:
        out += block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(data), len(data)) + data)
    return out
