import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import T0  # noqa: E402
from wiretide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, app="wiretide-tests", memory="4g")


@pytest.fixture(scope="session")
def make_packets(spark):
    """Packet rows from short tuples; anything left out has a harmless default."""
    def build(rows, raw=False):
        full = []
        for i, row in enumerate(rows):
            base = dict(pkt_id=i, ts_us=T0, src_ip="10.0.0.1", dst_ip="203.0.113.9", src_port=40000, dst_port=443, protocol="TCP",
                        packet_length=100, payload_length=46, syn=False, ack=True, fin=False, rst=False, psh=False, urg=False)
            base.update(row)
            if "t" in base:
                base["ts_us"] = T0 + round(base.pop("t") * 1_000_000)
            full.append(base)
        schema = ("pkt_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_length int, "
                  "payload_length int, syn boolean, ack boolean, fin boolean, rst boolean, psh boolean, urg boolean")
        names = [part.split()[0] for part in schema.split(", ")]
        if raw:
            schema, names = schema + ", raw_payload binary", names + ["raw_payload"]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema)
    return build
