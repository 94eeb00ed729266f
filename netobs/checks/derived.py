"""Traffic derived from the driver tables: one or more frames per table row.

``pulse`` compresses the clock of ``events`` to 0.7 s per row so that windows of
seconds matter; ``pk`` reads it as packets.  The builders below encode frames as
hex text with Spark expressions, which gives decode jobs an input whose right
answer is a plain column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.functions.bytes import let
from netobs.plans.stage import stage

GATEWAY = "02000000ff01"
Hex = Column | str


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pulse_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("seq"),
        (e * 700000).alias("ts_us"),
        F.timestamp_micros(e * 700000).alias("ts"),
        F.floor(e * 7 / 10).alias("ts_s"),
        "user_id",
        (F.col("user_id") % 20).alias("dev"),
        (F.col("user_id") % 7).alias("ipk"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def pk_of(pulse: DataFrame) -> DataFrame:
    k, dev, seq = F.col("k"), F.col("dev"), F.col("seq")
    ports = F.array(*[F.lit(p) for p in (80, 443, 53, 8080, 5353, 1900, 67, 22)])
    return pulse.select(
        "seq", "ts", "ts_us", "ts_s", "dev", "ipk", "event_type", "k",
        F.concat(F.lit("02:00:00:00:00:"), F.format_string("%02x", dev)).alias("mac"),
        F.format_string("192.168.%d.%d", dev % 4, dev + 10).alias("src_ip"),
        F.format_string(
            "%d.%d.113.%d",
            F.when(k < 30, F.lit(10)).when(k < 60, F.lit(203)).otherwise(F.lit(198)), k % 5, k,
        ).alias("dst_ip"),
        ((seq * 37) % 60000 + 1024).cast("int").alias("sport"),
        F.element_at(ports, k % 8 + 1).alias("dport"),
        F.when(k % 3 == 0, F.lit(17)).otherwise(F.lit(6)).alias("proto"),
        F.element_at(F.array(*[F.lit(v) for v in (0, 20, 30, 100)]), k % 4 + 1).alias("outer_vlan"),
        F.when(k % 4 == 3, F.lit(20)).otherwise(F.lit(0)).alias("inner_vlan"),
    )


def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulse_of(table(spark, sf_dir, "events"))


def pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk_of(pulse(spark, sf_dir))


def spread(df: DataFrame, key: str = "seq") -> DataFrame:
    """Rows dealt to all cores before frames are built of them.

    A frame costs far more than the row it is made of, and a small file is one task.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines: half inside a sensor envelope, one in ten marked routed."""
    k = F.col("k").cast("string")
    vlan = F.when(F.col("k") % 4 == 0, F.lit("0")).when(F.col("k") % 4 == 2, F.lit("100/20")).otherwise(F.lit("20"))
    envelope = F.when(
        F.col("k") % 2 == 0,
        F.concat(F.lit("OBS|sensor-"), (F.col("dev") % 3).cast("string"), F.lit("|lan3|"), vlan, F.lit("|")),
    ).otherwise(F.lit(""))

    def line(*parts) -> Column:
        return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    mac, src, dst = F.col("mac"), F.col("src_ip"), F.col("dst_ip")
    kind = F.col("event_type")
    record = (
        F.when(kind == "view", line("DNS", mac, src, F.concat(F.lit("host"), k, F.lit(".example.com"))))
        .when(
            kind == "click",
            line("SYN", mac, src, "64", "61000", "6", "1440", F.lit("M*,N,W*,S,T"), F.col("dport").cast("string")),
        )
        .when(
            kind == "purchase",
            line("TLS", mac, src, dst, "443", F.concat(F.lit("shop"), k, F.lit(".example.com")),
                 "t13d0302h2_aaaaaaaaaaaa_bbbbbbbbbbbb", "h2"),
        )
        .when(
            kind == "signup",
            line("DHCP", mac, src, F.concat(F.lit("host-"), F.col("dev").cast("string")), "MSFT 5.0", "1,3,6,15"),
        )
        .otherwise(line("ARP", mac, src, dst, "request"))
    )
    tail = F.when(F.col("k") % 10 == 9, F.lit("|routed")).otherwise(F.lit(""))
    return pk(spark, sf_dir).select("ts", "seq", "ts_s", F.concat(envelope, record, tail).alias("line"))


# -- hex builders ---------------------------------------------------------------


def hx(value: Column | int, n: int) -> Column:
    """Integer as ``n`` bytes of hex."""
    v = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(v.cast("bigint")), 2 * n, "0")


def cat(*parts: Hex) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def size(h: Hex) -> Column:
    c = F.lit(h) if isinstance(h, str) else h
    return F.shiftright(F.octet_length(c), 1)  # digits are one byte each, so they need not be counted


def text_hex(text: Column | str) -> Column:
    c = F.lit(text) if isinstance(text, str) else text
    return F.hex(F.encode(c, "UTF-8"))


def mac_hex(mac: str = "mac") -> Column:
    return F.replace(F.col(mac), F.lit(":"), F.lit(""))


def ip_hex(ip: Column | str) -> Column:
    c = F.lit(ip) if isinstance(ip, str) else ip
    return let(F.split(c, "\\."), lambda parts: cat(*[hx(parts[i].cast("int"), 1) for i in range(4)]))


def once(h: Hex, f) -> Column:
    """Use a hex text several times without repeating its expression."""
    return let(cat(h), f)


def sized(body: Hex, n: int, extra: int = 0) -> Column:
    """``body`` behind its length in ``n`` bytes."""
    return once(body, lambda h: cat(hx(size(h) + extra, n), h))


def ipv4(proto: Column | int, src: Hex, dst: Hex, body: Hex, ttl: Column | int = 64, frag: Column | int = 0) -> Column:
    return once(
        body,
        lambda h: cat(
            "4500", hx(size(h) + 20, 2), "0000", hx(frag, 2), hx(ttl, 1), hx(proto, 1), "0000", src, dst, h
        ),
    )


def ipv6(next_hdr: Column | int, src: Hex, dst: Hex, body: Hex, hops: Column | int = 64) -> Column:
    return once(
        body, lambda h: cat("60000000", hx(size(h), 2), hx(next_hdr, 1), hx(hops, 1), src, dst, h)
    )


def tcp(sport, dport, flags, body: Hex = "", options: Hex = "", window: Column | int = 64240) -> Column:
    return once(
        options,
        lambda o: cat(
            hx(sport, 2), hx(dport, 2), "0000000100000000",
            hx((F.floor(size(o) / 4).cast("int") + 5) * 16, 1), hx(flags, 1), hx(window, 2), "00000000", o, body,
        ),
    )


def udp(sport, dport, body: Hex) -> Column:
    return once(body, lambda h: cat(hx(sport, 2), hx(dport, 2), hx(size(h) + 8, 2), "0000", h))


def ether(dst: Hex, src: Hex, ether_type: str, body: Hex, tags: Hex = "") -> Column:
    return cat(dst, src, tags, ether_type, body)


def as_frames(df: DataFrame, frame_hex: Column, link_type: Column | str = "ethernet", iface: Column | str = "lan0") -> DataFrame:
    lt = F.lit(link_type) if isinstance(link_type, str) else link_type
    ifc = F.lit(iface) if isinstance(iface, str) else iface
    aux = F.col("aux_vlan") if "aux_vlan" in df.columns else F.lit(None).cast("int")
    return stage(
        df.withColumns({"iface": ifc, "link_type": lt, "aux_vlan": aux}),
        {"data": F.unhex(frame_hex)},
    ).select("ts", "seq", "iface", "link_type", "aux_vlan", "data")


def labels_hex(name: Column) -> Column:
    """DNS labels of a dotted name, without the final zero."""
    return F.array_join(F.transform(F.split(name, "\\."), lambda p: F.concat(hx(F.length(p), 1), text_hex(p))), "")


def dns_hex(txid: Column, flags: str, name: Column, qtype: Column | int = 1) -> Column:
    return cat(hx(txid, 2), flags, "0001000000000000", labels_hex(name), "00", hx(qtype, 2), "0001")


def u16_list_hex(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda v: hx(v, 2)), "")


def extension_hex(typ: Column | int, body: Hex) -> Column:
    return cat(hx(typ, 2), sized(body, 2))


def hello_hex(ciphers: Column, extensions: Hex, session: str = "") -> Column:
    """ClientHello handshake message (type 1) with legacy version 0303."""
    body = cat(
        "0303", "ab" * 32, hx(len(session) // 2, 1), session, sized(u16_list_hex(ciphers), 2), "0100",
        sized(extensions, 2),
    )
    return cat("01", sized(body, 3))


def record_hex(hello: Hex) -> Column:
    return cat("160301", sized(hello, 2))


def event_hello(k: Column, seq: Column) -> Column:
    """A hello whose ciphers, extensions, name and protocol depend on the event."""
    ciphers = F.array(seq % 3 + 4865, F.lit(2570), F.lit(49195) - seq % 5, F.lit(4867))
    sni = text_hex(F.concat(F.lit("shop"), k.cast("string"), F.lit(".example.com")))
    sni_ext = extension_hex(0, sized(cat("00", sized(sni, 2)), 2))
    alpn_ext = extension_hex(16, "0003026832")
    versions = extension_hex(43, "06" + "0a0a" + "0304" + "0303")
    exts = cat(
        F.when(k % 4 != 0, sni_ext).otherwise(F.lit("")),
        F.when(k % 3 != 0, alpn_ext).otherwise(F.lit("")),
        F.when(k % 2 == 0, versions).otherwise(F.lit("")),
        extension_hex(seq % 4 + 10, ""), extension_hex(6682, "00"), extension_hex(51, "0000"),
        extension_hex(13, "00020403"),
    )
    return hello_hex(ciphers, exts)


# -- QUIC -----------------------------------------------------------------------


def quic_initial(dcid: Column, pn: Column, plain: Column, token: str = "", size: int = 4) -> Column:
    """Protected v1 Initial packet (binary) with a packet number cut to ``size`` bytes.

    Uses Spark's AES functions the other way round; ``plain`` must be long
    enough for the header sample.
    """
    from netobs.functions.bytes import bits, blob, drop, let, take, u8
    from netobs.functions.quic import header_mask, nonce, quic_client_keys

    low = pn.cast("bigint") % (1 << 8 * size)

    def header(p):
        return F.concat(
            blob(f"c{size - 1:x}00000001"), F.unhex(hx(F.length(dcid), 1)), dcid, blob("00"),
            F.unhex(hx(len(token) // 2, 1)), F.lit(bytes.fromhex(token)),
            F.unhex(hx(F.length(p) + 16 + size + 16384, 2)), F.unhex(hx(low, size)),
        )

    def seal(k):
        return let(plain, lambda p: let(header(p), lambda head: sealed(k, p, head)))

    def sealed(k, p, head):
        body = F.aes_encrypt(p, k["key"], F.lit("GCM"), F.lit("DEFAULT"), nonce(k["iv"], pn), head)
        return let(
            drop(body, 12),
            lambda ct: let(header_mask(k["hp"], take(ct, 4 - size, 16)), lambda m: mask(head, ct, m)),
        )

    def mask(head, ct, m):
        n = F.length(head)
        first = u8(head, 0).bitwiseXOR(bits(u8(m, 0), 15))
        hidden = low.bitwiseXOR(F.conv(F.hex(take(m, 1, size)), 16, 10).cast("bigint"))
        return F.concat(F.unhex(hx(first, 1)), take(head, F.lit(1), n - 1 - size), F.unhex(hx(hidden, size)), ct)

    return let(quic_client_keys(dcid), seal)


def crypto_frame_hex(offset: Column | int, body: Hex) -> Column:
    """CRYPTO frame with two-byte offset and length."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return cat("06", hx(off + 16384, 2), sized(body, 2, 16384))


def pad_hex(body: Column, n: int) -> Column:
    """Right-pad with PADDING frames to ``n`` bytes."""
    return let(body, lambda h: F.concat(F.substring(h, 1, 2 * n), F.repeat(F.lit("0"), F.lit(2 * n) - F.length(h))))
