"""Capture files (pcap and pcapng with Ethernet frames) to packets and counters, in parallel over files."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: magic numbers, block and option types, link type, protocol and header numbers.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION, INTERFACE, SIMPLE, STATISTICS, ENHANCED = 0x0A0D0D0A, 1, 3, 5, 6
ETHERNET, VLAN, IPV4, IPV6, TCP = 1, (0x8100, 0x88A8, 0x9100), 0x0800, 0x86DD, 6
EXTENSIONS = (0, 43, 60, 135)
HEADERS = 54
PACKETS = "path string, packet long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ip_length int, tcp_flags int"
STATS = "path string, total_packets long, tcp_packets long, skipped_packets long, first_us long, last_us long, received long, dropped long, drop_status string, error string"


class Malformed(ValueError):
    pass


def frames(data: bytes) -> Iterator[tuple[int, int | None, int | None]]:
    """(ts_us, place, size) of the frames of a pcap or pcapng file; the interface's counters of a pcapng come as (-1, received, dropped)."""
    if data[:4] in MAGIC:
        yield from _pcap(data)
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(data)
    else:
        raise Malformed("neither pcap nor pcapng")


def _pcap(data: bytes) -> Iterator[tuple[int, int, int]]:
    order, per_us = MAGIC[data[:4]]
    if len(data) < 24:
        raise Malformed("short file header")
    if struct.unpack_from(f"{order}I", data, 20)[0] & 0xFFFF != ETHERNET:
        raise Malformed("link type")
    at, head, end = 24, struct.Struct(f"{order}3I"), len(data)
    while at + 16 <= end:
        seconds, part, kept = head.unpack_from(data, at)
        yield seconds * 1_000_000 + part // per_us, at + 16, min(kept, end - at - 16)
        at += 16 + kept


def _options(order: str, body: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        kind, n = struct.unpack_from(f"{order}2H", body, at)
        if kind == 0:
            break
        out[kind] = body[at + 4 : at + 4 + n]
        at += 4 + (n + 3) // 4 * 4
    return out


def _pcapng(data: bytes) -> Iterator[tuple[int, int | None, int | None]]:
    at, order, ticks = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, ticks = ("<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(f"{order}2I", data, at)
        if size < 12 or at + size > len(data):
            raise Malformed("block size")
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE:
            if struct.unpack_from(f"{order}H", body)[0] != ETHERNET:
                raise Malformed("link type")
            resolution = _options(order, body[8:]).get(9, b"\x06")[0]
            ticks.append(2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution)
        elif kind == ENHANCED:
            interface, high, low, kept = struct.unpack_from(f"{order}4I", body)
            unit = ticks[interface] if interface < len(ticks) else 1_000_000
            yield ((high << 32) | low) * 1_000_000 // unit, at - size + 28, min(kept, len(body) - 20)
        elif kind == SIMPLE:
            yield 0, at - size + 12, max(0, len(body) - 4)
        elif kind == STATISTICS:
            counters = _options(order, body[12:])
            yield -1, *(struct.unpack(f"{order}Q", counters[k])[0] if len(counters.get(k, b"")) == 8 else None for k in (4, 5))


def tcp_packet(frame: bytes) -> tuple | None:
    """src_ip, src_port, dst_ip, dst_port, length, flags of a TCP frame, None for other frames; Malformed if it is cut short."""
    try:
        at, kind = 14, struct.unpack_from(">H", frame, 12)[0]
        while kind in VLAN:
            kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
        if kind == IPV4:
            if frame[at] >> 4 != 4:
                raise Malformed("version")
            head, total = (frame[at] & 15) * 4, struct.unpack_from(">H", frame, at + 2)[0]
            if frame[at + 9] != TCP or struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF:
                return None
            src, dst, rest, at = frame[at + 12 : at + 16], frame[at + 16 : at + 20], total - head, at + head
        elif kind == IPV6:
            rest, proto = struct.unpack_from(">HB", frame, at + 4)
            src, dst, at = frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + 40
            while proto in EXTENSIONS:
                proto, n = frame[at], (frame[at + 1] + 1) * 8
                at, rest = at + n, rest - n
            if proto != TCP:
                return None
        else:
            return None
        sport, dport = struct.unpack_from(">2H", frame, at)
        offset, flags = frame[at + 12] >> 4, frame[at + 13]
        return str(ipaddress.ip_address(src)), sport, str(ipaddress.ip_address(dst)), dport, max(0, rest - offset * 4) + HEADERS, flags
    except (struct.error, IndexError) as e:
        raise Malformed(str(e)) from e


#: Of a plain frame, all that a TCP packet over IPv4 without VLAN tags needs: Ethernet and the least headers of IPv4 and TCP.
PLAIN = 14 + 20 + 14


def _plain(data: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which frames at those places tcp_packet gives a row from their IPv4 header, and the values of those rows."""
    raw = np.frombuffer(data, np.uint8)
    wide = lambda k, n: sum(raw[k + i].astype(np.int64) << (8 * (n - 1 - i)) for i in range(n))
    rows = np.flatnonzero(size >= PLAIN)
    rows = rows[(wide(at[rows] + 12, 2) == IPV4) & (raw[at[rows] + 14] >> 4 == 4) & (raw[at[rows] + 23] == TCP) & (wide(at[rows] + 20, 2) & 0x1FFF == 0)]
    head = (raw[at[rows] + 14] & 15).astype(np.int64) * 4
    whole = size[rows] >= 14 + head + 14
    rows, head = rows[whole], head[whole]
    ip = at[rows] + 14
    tcp = ip + head
    rest = wide(ip + 2, 2) - head - (raw[tcp + 12] >> 4).astype(np.int64) * 4
    return rows, {"src_ip": wide(ip + 12, 4), "src_port": wide(tcp, 2), "dst_ip": wide(ip + 16, 4), "dst_port": wide(tcp + 2, 2), "ip_length": np.maximum(0, rest) + HEADERS, "tcp_flags": raw[tcp + 13].astype(np.int64)}


def _texts(numbers: np.ndarray) -> np.ndarray:
    known, of = np.unique(numbers, return_inverse=True)
    return np.array([str(ipaddress.IPv4Address(int(n))) for n in known], dtype=object)[of]


def decode(path: str, data: bytes, rows: bool = True) -> tuple[pd.DataFrame | None, tuple]:
    """Packet rows, if wanted, and the counters of a file; a file that can't be read has an error and no packets."""
    times, places, sizes, received, dropped = [], [], [], None, None
    try:
        for ts, at, size in frames(data):
            if ts == -1:
                received, dropped = at, size
                continue
            times.append(ts)
            places.append(at)
            sizes.append(size)
    except (Malformed, struct.error, IndexError) as e:
        return _frame([], PACKETS) if rows else None, (path, 0, 0, 0, None, None, None, None, "unknown", str(e) or "malformed")
    plain, columns = _plain(data, np.array(places, dtype=np.int64), np.array(sizes, dtype=np.int64))
    others, skipped = [], 0
    for k in np.setdiff1d(np.arange(len(times)), plain, assume_unique=True).tolist():
        try:
            if (p := tcp_packet(data[places[k] : places[k] + sizes[k]])) is not None:
                others.append((path, k, times[k], *p[:4], "tcp", p[4], p[5]))
        except Malformed:
            skipped += 1
    counters = (path, len(times), len(plain) + len(others), skipped, times[0] if times else None, times[-1] if times else None, received, dropped, "unknown" if dropped is None else "reported", None)
    if not rows:
        return None, counters
    own = {c.split()[0]: None for c in PACKETS.split(", ")} | {"path": path, "packet": plain, "ts_us": np.array(times, dtype=np.int64)[plain], "protocol": "tcp"} | columns
    found = pd.DataFrame(own | {k: _texts(columns[k]) for k in ("src_ip", "dst_ip")})
    return pd.concat([found, _frame(others, PACKETS)]).sort_values("packet") if others else found, counters


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith((" long", " int"))})


def _packets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, data in zip(part["path"], part["content"]):
            yield decode(path, bytes(data))[0]


def _stats(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield _frame([decode(path, bytes(data), rows=False)[1] for path, data in zip(part["path"], part["content"])], STATS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def packets_of(files: DataFrame) -> DataFrame:
    """Packets of capture files (path, content)."""
    return files.select("path", "content").mapInPandas(_packets, PACKETS)


def stats_of(files: DataFrame) -> DataFrame:
    """Counters of capture files (path, content)."""
    return files.select("path", "content").mapInPandas(_stats, STATS)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return packets_of(_files(spark, path))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return stats_of(_files(spark, path))


def file_signatures(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("path", F.sha2("content", 256).alias("signature"))
