"""Protocol tags of reads against the rules in plain Python."""

import random
import struct

from netlens.operators import inference


def tag(raw, total, before):
    """(protocol, message, prepended), or None; before is the four-byte read before, or None."""
    n = len(raw)
    if n >= 5 and raw[:4] == b"HTTP":
        return 2, "resp", False
    if n >= 5 and (raw[:3] == b"GET" or raw[:4] in (b"HEAD", b"POST")):
        return 2, "req", False
    if n >= 16:
        length, ident, to, op = struct.unpack("<iiii", raw[:16])
        if length >= 16 and ident >= 0 and to == 0 and op in (2001, 2002, 2003, 2004, 2005, 2006, 2007, 2012, 2013):
            return 10, "req", False
    told = before is not None and struct.unpack("<I", before)[0] == n
    whole = before + raw if told else raw
    if len(whole) >= 5 and whole[3] == 0 and 0 < int.from_bytes(whole[:3], "little") <= 10000 and whole[4] in (0x03, 0x0B, 0x16, 0x17, 0x19):
        return 4, "req", False
    if n >= 16:
        frame, header = struct.unpack(">iI", raw[:8])
        if 0 < frame <= n - 4 and header & 0xFFFFFF == frame - 4 and frame > 4:
            if header >> 24 == 0 and raw[8:16] == b'{"code":' or header >> 24 == 1 and struct.unpack(">H", raw[8:10])[0] >= 10 and raw[10] <= 13:
                return 14, "req", False
    ahead = before is not None and struct.unpack(">I", before)[0] in (n, total)
    body = raw if ahead else raw[4:]
    if n + 4 * ahead >= 12 and (ahead or struct.unpack(">I", raw[:4])[0] + 4 in (n, total)):
        key, version, ident = struct.unpack(">hhi", body[:8])
        if 0 <= key <= 62 and 0 <= version <= 17 and ident >= 0:
            return 11, "req", ahead
    if 12 <= n <= 512:
        flags, *counts = struct.unpack(">HHHHH", raw[2:12])
        if not flags >> 6 & 1 and not flags >> 11 & 15 and 0 < counts[0] <= 10 and sum(counts) <= 25:
            return 7, "resp" if flags >> 15 else "req", False
    if n >= 3 and raw[:1] in b"+-:$*" and raw[-2:] == b"\r\n":
        return 8, "any", False
    return None


def a_read(rng):
    """One or two reads: well-formed messages, some with a byte changed or cut off."""
    body = bytes(rng.choice([0, 0, 1, 3, 22, 65, 255]) for _ in range(rng.choice([8, 9, 12, 20])))
    kafka = struct.pack(">hhi", rng.randint(-1, 64), rng.randint(0, 19), rng.randint(-1, 9)) + body
    query = bytes([rng.choice([3, 11, 22, 23, 25, 1])]) + body
    rocket = rng.choice([b'{"code":1}' + body, struct.pack(">HB", rng.randint(8, 12), rng.randint(11, 15)) + body + b"\0" * 9])
    kinds = [
        [b"GET / HTTP/1.1\r\n"], [b"HTTP/1.1 200\r\n"], [b"HEAD"], [b"+OK\r\n"], [b"$-1\r\n"], [b":\n"],
        [struct.pack("<iiii", rng.choice([15, 16, 40]), rng.choice([-1, 5]), rng.choice([0, 0, 1]), rng.choice([2013, 2003, 1])) + body],
        [struct.pack("<I", len(query))[:3] + bytes([rng.choice([0, 0, 1])]) + query], [struct.pack("<I", len(query)), query], [struct.pack("<I", len(query) + 1), query],
        [struct.pack(">I", len(kafka)) + kafka], [struct.pack(">I", len(kafka)), kafka], [struct.pack(">I", len(kafka) + 7), kafka], [struct.pack(">I", len(kafka) + 7) + kafka],
        [struct.pack(">II", len(rocket) + 4, len(rocket) | rng.choice([0, 1, 2]) << 24) + rocket],
        [struct.pack(">HHHHHH", 7, rng.choice([0x0100, 0x8180, 0x0140, 0x0800]), rng.randint(0, 11), rng.choice([0, 20]), 0, rng.choice([0, 5])) + body], [body], [b""],
    ]
    reads = rng.choice(kinds)
    if rng.random() < 0.2:
        at = rng.randrange(len(reads))
        raw = bytearray(reads[at])
        if raw:
            raw[rng.randrange(len(raw))] = rng.choice([0, 1, 255])
        reads = [*reads[:at], bytes(raw), *reads[at + 1:]]
    return reads


def test_reads_and_connections(spark):
    rng, rows, want, first = random.Random(1), [], {}, {}
    for conn in range(40):
        before, at = None, 0
        for _ in range(60):
            for raw in a_read(rng):
                at += 1
                more = rng.choice([0, 0, 7])
                egress = rng.random() < 0.5
                rows.append((conn, at // 3, at, egress, raw, len(raw) + more))
                got = want[conn, at] = tag(raw, len(raw) + more, before)
                before = raw if len(raw) == 4 else None
                if got and conn not in first:
                    first[conn] = (got[0], "unknown" if got[1] == "any" else "client" if egress == (got[1] == "req") else "server", at // 3, got[2])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conn_id long, ts_ns long, arrival long, egress boolean, payload binary, whole long")
    out = {(r.conn_id, r.arrival): None if r.protocol is None else (r.protocol, r.message, r.prepended) for r in inference.tagged_reads(df, total="whole").collect()}
    assert out == want and {v[0] for v in want.values() if v} == {2, 4, 7, 8, 10, 11, 14} and any(v and v[2] for v in want.values())
    assert {r.conn_id: (r.protocol, r.role, r.ts_ns, r.prepended) for r in inference.inferred_connections(df, total="whole").collect()} == first
