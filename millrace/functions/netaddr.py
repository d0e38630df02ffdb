"""Network addresses: range lookup (geography, network numbers) and host names.

Host names come as a table, or from a name server that Python workers ask."""

from __future__ import annotations

import random
import socket
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import string_to_ip
from millrace.operators.enrich import enrich

#: Fields of a geographic entry, and days that a host name is valid for (fixed values).
HOST_DAYS = 3
GEO_FIELDS = ["asnCode", "countryCode", "countryName", "region", "city", "postalCode", "areaCode"]


def range_lookup(df: DataFrame, ip: str, ranges: DataFrame, *, bits: int = 16) -> DataFrame:
    """Left join of addresses to disjoint ranges (lo, hi, ...) by number.

    A range is entered under every block of 2**bits addresses that it touches, so
    the join is an equi-join on the block, with the bounds as a filter: no nested
    loop, whatever the number of ranges. state is FAILURE where none is found."""
    block = F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits)))
    entered = ranges.withColumn("_block", block)
    keyed = df.withColumn("_ip", string_to_ip(F.col(ip))).withColumn("_at", F.shiftright(F.col("_ip"), bits))
    hit = (F.col("_at") == F.col("_block")) & F.col("_ip").between(F.col("lo"), F.col("hi"))
    got = keyed.join(entered, hit, "left")
    return got.withColumn("state", F.when(F.col("lo").isNotNull(), "OK").otherwise("FAILURE")).drop("_ip", "_at", "_block")


def host_names(df: DataFrame, ip: str, names: DataFrame) -> DataFrame:
    """Left join to (ip, hostname): the trailing dot is cut; no name is a FAILURE."""
    names = names.select(F.col("ip").alias("_ip"), F.regexp_replace("hostname", r"\.\z", "").alias("hostname"))
    got = df.join(names, F.col(ip) == F.col("_ip"), "left").drop("_ip")
    return got.withColumn("state", F.when(F.col("hostname").isNotNull(), "OK").otherwise("FAILURE"))


def geo_lookup(df: DataFrame, ip: str, ranges: DataFrame, **how) -> DataFrame:
    """The seven geographic fields of an address, from ranges (lo, hi, and those of the fields that are known); an entry without a country is a FAILURE."""
    full = ranges.select("lo", "hi", *((F.col(f).cast("string") if f in ranges.columns else F.lit(None).cast("string")).alias(f) for f in GEO_FIELDS))
    got = range_lookup(df, ip, full, **how)
    return got.withColumn("state", F.when(F.col("countryCode").isNull(), "FAILURE").otherwise(F.col("state"))).drop("lo", "hi")


def ptr_query(ip: str, number: int) -> bytes:
    """A question for the name of an IPv4 address, in the form of RFC 1035."""
    labels = [*reversed(ip.split(".")), "in-addr", "arpa"]
    name = b"".join(bytes([len(x)]) + x.encode("ascii") for x in labels) + b"\0"
    return struct.pack(">6H", number, 0x0100, 1, 0, 0, 0) + name + struct.pack(">2H", 12, 1)


def read_name(packet: bytes, at: int) -> tuple[str, int]:
    """A name, which may point to an earlier one, and where what follows begins."""
    labels, end, jumps = [], None, 0
    while packet[at]:
        if packet[at] >= 0xC0:
            end = end or at + 2
            at = (packet[at] & 0x3F) << 8 | packet[at + 1]
            if (jumps := jumps + 1) > 16:
                raise ValueError("a name that points in a circle")
        else:
            labels.append(packet[at + 1 : at + 1 + packet[at]].decode("ascii", "replace"))
            at += 1 + packet[at]
    return ".".join(labels), end or at + 1


def ptr_answer(packet: bytes, number: int) -> str | None:
    """The first name in an answer; None if there is none."""
    got, flags, questions, answers = struct.unpack(">4H", packet[:8])
    if got != number or flags & 0xF:
        return None
    at = 12
    for _ in range(questions):
        at = read_name(packet, at)[1] + 4
    for _ in range(answers):
        at = read_name(packet, at)[1]
        kind, _, _, size = struct.unpack(">2HIH", packet[at : at + 10])
        if kind == 12:
            return read_name(packet, at + 10)[0] or None
        at += 10 + size
    return None


def asked(nameserver: str, timeout: float = 2.0, tries: int = 2) -> Callable[[DataFrame], DataFrame]:
    """Turns distinct addresses into entries by asking a name server (host or host:port); what fails is a FAILURE."""
    host, _, port = nameserver.partition(":")

    def one(sock: socket.socket, ip: str) -> str | None:
        for _ in range(tries):
            number = random.getrandbits(16)
            try:
                sock.sendto(ptr_query(ip, number), (host, int(port or 53)))
                return ptr_answer(sock.recv(4096), number)
            except (OSError, ValueError, IndexError, struct.error, UnicodeError):
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sock:
            sock.settimeout(timeout)
            for b in batches:
                names = [one(sock, ip) for ip in b["key"]]
                yield pd.DataFrame({"key": b["key"], "fields": [None if n is None else {"hostname": n.rstrip(".")} for n in names], "state": ["FAILURE" if n is None else "OK" for n in names]})

    return lambda keys: keys.select("key").mapInPandas(run, "key string, fields map<string,string>, state string")


def named(names: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Turns distinct addresses into entries by a table (ip, hostname)."""

    def compute(keys: DataFrame) -> DataFrame:
        got = host_names(keys.select("key"), "key", names)
        return got.select("key", F.when(F.col("hostname").isNotNull(), F.create_map(F.lit("hostname"), "hostname")).alias("fields"), "state")

    return compute


def host_engine(df: DataFrame, ip: str, resolve: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, now=None, days: int = HOST_DAYS) -> tuple[DataFrame, DataFrame]:
    """(df with hostname and state, the entries after this run). Each distinct address
    is resolved once, and only if the cache has no valid entry of the last days."""
    got, entries = enrich(df, ip, resolve, cache, days=days, now=now)
    return got.withColumn("hostname", F.col("fields")["hostname"]).drop("fields"), entries
