"""Scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks.registry import PK, PULSE, query
from netobs.functions.bytes import varint_value
from netobs.functions.dns import dhcp6_name, dns_name, dns_qtype, netbios_name
from netobs.functions.quic import V1_SALT, quic_client_keys, quic_packet_number
from netobs.functions.text import entropy, find_ci, md5_12, sanitize_text
from netobs.functions.tls import is_grease, ja4_like, tls_client_hello, tls_version
from netobs.functions.tlv import ndp_opts, opt8, opt16, tcp_options, tlv16
from netobs.operators.records import dhcp6_duid_name, dhcp6_msg_name, flag_letters
from netobs.checks import derived as g
from netobs.plans.stage import stage

# One blank per UTF-8 byte outside printable ASCII, and per pipe.
CLEAN = r"""clean AS (
  SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '[\x{10000}-\x{10FFFF}]', '    ', 'g'), '[\x{0800}-\x{FFFF}]', '   ', 'g'), '[\x{0080}-\x{07FF}]', '  ', 'g'),
    '[^ -~]|\|', ' ', 'g') AS t FROM documents)"""


def cleaned(spark, sf):
    docs = g.table(spark, sf, "documents")
    return stage(docs.select("doc_id", "source", "text"), {"t": sanitize_text(F.col("text"))}, drop=("text",))


@query("sanitize_text", "SELECT doc_id, length(t) AS n, md5(t) AS h, md5(lower(t)) AS hl FROM clean", CLEAN)
def _sanitize(spark, sf):
    return cleaned(spark, sf).select(
        "doc_id", F.length("t").alias("n"), F.md5("t").alias("h"), F.md5(F.lower("t")).alias("hl")
    )


ENTROPY_SQL = """, c AS (
  SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM clean) GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
e AS (SELECT c.doc_id, 0.0 - sum((n / total) * log2(n / total)) AS ent FROM c JOIN s USING (doc_id) GROUP BY 1)
"""


@query("entropy_text", ENTROPY_SQL + "SELECT doc_id, round(ent, 4) AS entropy FROM e", CLEAN)
def _entropy_text(spark, sf):
    return cleaned(spark, sf).select("doc_id", F.round(entropy(F.col("t")), 4).alias("entropy"))


@query(
    "entropy_alert",
    ENTROPY_SQL + "SELECT doc_id, round(ent, 2) AS entropy FROM e WHERE CAST(ent AS FLOAT) >= CAST(4.2 AS FLOAT)",
    CLEAN,
)
def _entropy_alert(spark, sf):
    df = stage(cleaned(spark, sf), {"e": entropy(F.col("t"))})
    high = df.where(F.col("e").cast("float") >= F.lit(4.2).cast("float"))
    return high.select("doc_id", F.round("e", 2).alias("entropy"))


@query(
    "entropy_words",
    """, w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(t, ' ')) AS word FROM clean)
  WHERE word <> '' GROUP BY 1),
c AS (SELECT word, n, map_values(list_histogram(string_split(word, ''))) AS ks FROM w)
SELECT word, n, round(0.0 - list_sum(list_transform(ks, lambda k: (k / length(word)) * log2(k / length(word)))), 4) AS entropy
FROM c""",
    CLEAN,
)
def _entropy_words(spark, sf):
    """Distinct words are counted first, so each is measured once."""
    words = cleaned(spark, sf).select(F.explode(F.split("t", " ")).alias("word")).where(F.col("word") != "")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", "n", F.round(entropy(F.col("word")), 4).alias("entropy"))


@query(
    "find_ci",
    "SELECT doc_id, strpos(lower(t), 'the ') AS pos FROM clean",
    CLEAN,
)
def _find_ci(spark, sf):
    return cleaned(spark, sf).select("doc_id", find_ci(F.col("t"), "The ").alias("pos"))


@query("md5_12", "SELECT doc_id, substr(md5(t), 1, 12) AS h FROM clean", CLEAN)
def _md5_12(spark, sf):
    return cleaned(spark, sf).select("doc_id", md5_12(F.col("t")).alias("h"))


@query(
    "grease",
    """SELECT seq, v, CAST(v // 256 = v % 256 AND v % 16 = 10 AS INTEGER) AS grease
FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN (seq % 16) * 4112 + 2570 % 4096 ELSE (seq * 257) % 65536 END AS v FROM pulse)""",
    PULSE,
)
def _grease(spark, sf):
    v = F.when(F.col("seq") % 3 == 0, (F.col("seq") % 16) * 4112 + 2570).otherwise((F.col("seq") * 257) % 65536)
    return g.pulse(spark, sf).select("seq", v.alias("v")).withColumn("grease", is_grease(F.col("v").cast("int")).cast("int"))


@query(
    "tls_version",
    """SELECT seq, CASE k % 7 WHEN 0 THEN 's3' WHEN 1 THEN '10' WHEN 2 THEN '11' WHEN 3 THEN '12' WHEN 4 THEN '13'
ELSE '00' END AS version FROM pulse""",
    PULSE,
)
def _tls_version(spark, sf):
    return g.pulse(spark, sf).select("seq", tls_version(F.col("k") % 7 + 768).alias("version"))


HOSTS = r"""hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages)"""


def hosts(spark, sf):
    pages = g.table(spark, sf, "pages")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host")).where(
        F.col("host") != ""
    )


HEADER = "123401000001000000000000"


@query("dns_name", "SELECT page_id, host AS name, CAST(1 + page_id % 255 AS INTEGER) AS qtype FROM hosts WHERE host <> ''", HOSTS)
def _dns_name(spark, sf):
    """A third of the names ends in a pointer to its last label, stored behind the question."""
    h = hosts(spark, sf)
    parts = F.split(F.upper(F.col("host")), "\\.")
    last = F.element_at(parts, -1)
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    qtype = g.hx(F.col("page_id") % 255 + 1, 2)
    whole = g.cat(HEADER, g.labels_hex(F.upper(F.col("host"))), "00", qtype, "0001")
    head_hex = F.when(F.size(parts) > 1, g.labels_hex(head)).otherwise(F.lit(""))
    target = g.size(head_hex) + 12 + 2 + 4
    pointed = g.cat(
        HEADER, head_hex, g.hx(target + 49152, 2), qtype, "0001", g.labels_hex(last), "00"
    )
    h = stage(h, {"b": F.unhex(F.when(F.col("page_id") % 3 == 0, pointed).otherwise(whole))})
    return h.select("page_id", dns_name(F.col("b"), 12).alias("name"), dns_qtype(F.col("b"), 12).alias("qtype"))


@query("dhcp6_name", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN host END AS name FROM hosts WHERE host <> ''", HOSTS)
def _dhcp6_name(spark, sf):
    """One in four is cut inside its last label."""
    h = hosts(spark, sf)
    name = g.labels_hex(F.lower(F.col("host")))
    cut = F.when(F.col("page_id") % 4 == 0, F.expr("substring(x, 1, length(x) - 2)")).otherwise(
        F.concat(F.col("x"), F.lit("00"))
    )
    return stage(h.withColumn("x", name), {"b": F.unhex(cut)}).select(
        "page_id", dhcp6_name(F.col("b")).alias("name")
    )


@query(
    "netbios_name",
    "SELECT seq, upper(event_type) || k AS name FROM pulse",
    PULSE,
)
def _netbios_name(spark, sf):
    name = F.concat(F.upper("event_type"), F.col("k").cast("string"))
    padded = F.rpad(F.hex(F.encode(name, "UTF-8")), 32, "20")
    enc = F.encode(F.translate(padded, "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"), "UTF-8")
    return g.pulse(spark, sf).select("seq", netbios_name(enc).alias("name"))


@query(
    "dhcp6_codes",
    """SELECT seq, CASE k % 13 WHEN 1 THEN 'SOLICIT' WHEN 3 THEN 'REQUEST' WHEN 4 THEN 'CONFIRM' WHEN 5 THEN 'RENEW'
  WHEN 6 THEN 'REBIND' WHEN 8 THEN 'RELEASE' WHEN 9 THEN 'DECLINE' WHEN 11 THEN 'INFORMATION' ELSE 'OTHER' END AS msg,
  CASE k % 6 WHEN 1 THEN 'LLT' WHEN 2 THEN 'EN' WHEN 3 THEN 'LL' WHEN 4 THEN 'UUID' ELSE 'UNKNOWN' END AS duid FROM pulse""",
    PULSE,
)
def _dhcp6_codes(spark, sf):
    k = F.col("k")
    return g.pulse(spark, sf).select("seq", dhcp6_msg_name(k % 13).alias("msg"), dhcp6_duid_name(k % 6).alias("duid"))


@query(
    "tcp_options",
    """SELECT seq, CASE WHEN k % 6 IN (1, 2, 5) THEN 1000 + k END AS mss, CASE WHEN k % 6 IN (2, 5) THEN k % 15 END AS wscale,
  [NULL, 'M*', 'M*,N,W*,N,N,S', 'T,N,E', '?,S', 'M*,S,T,N,W*'][k % 6 + 1] AS opts FROM pulse""",
    PULSE,
)
def _tcp_options(spark, sf):
    k = F.col("k")
    mss, ws = g.cat("0204", g.hx(k + 1000, 2)), g.cat("0303", g.hx(k % 15, 1))
    layouts = F.array(
        F.lit(""), mss, g.cat(mss, "01", ws, "01010402"), F.lit("080a" + "00" * 8 + "0100ff"),
        F.lit("0203ff0402" + "ff"), g.cat(mss, "0402", "080a" + "00" * 8, "01", ws),
    )
    p = stage(g.pulse(spark, sf), {"b": F.unhex(F.element_at(layouts, k % 6 + 1))})
    return stage(p, {"o": tcp_options(F.col("b"))}).select("seq", "o.mss", "o.wscale", "o.opts")


def _elements(df, opts):
    item = F.transform(F.col("o"), lambda x: F.concat(x["t"].cast("string"), F.lit("="), F.lower(F.hex(x["v"]))))
    return stage(df, {"o": opts}).select("seq", F.array_join(item, " ").alias("items"))


@query(
    "tlv16",
    "SELECT seq, '1=0401 5=' || lower(hex('host' || k)) || CASE WHEN k % 3 = 0 THEN '' ELSE ' 6=' || repeat('61', 200 + k) END AS items FROM pulse",
    PULSE,
)
def _tlv16(spark, sf):
    """The third element is one byte short in a third of the rows; data after the end is ignored."""
    k = F.col("k")
    name = g.text_hex(F.concat(F.lit("host"), k.cast("string")))
    long = F.repeat(F.lit("61"), k + 200)
    head = g.hx(k + (200 + 6 * 512), 2)
    body = g.cat("02020401", g.once(name, lambda h: g.cat(g.hx(g.size(h) + 5 * 512, 2), h)), head)
    b = F.when(k % 3 == 0, g.cat(body, F.repeat(F.lit("61"), k + 199))).otherwise(g.cat(body, long, "0000", "0a02ffff"))
    return _elements(stage(g.pulse(spark, sf), {"b": F.unhex(b)}), tlv16(F.col("b")))


@query(
    "opt8",
    "SELECT seq, '53=01 12=' || lower(hex('host-' || dev)) || CASE WHEN k % 2 = 0 THEN ' 55=0103' ELSE '' END AS items FROM pulse",
    PULSE,
)
def _opt8(spark, sf):
    k = F.col("k")
    name = g.text_hex(F.concat(F.lit("host-"), F.col("dev").cast("string")))
    b = g.cat("350101", "0000", "0c", g.sized(name, 1), "00", F.when(k % 2 == 0, F.lit("37020103ff3701aa")).otherwise(F.lit("370401")))
    return _elements(stage(g.pulse(spark, sf), {"b": F.unhex(b)}), opt8(F.col("b")))


@query(
    "opt16",
    "SELECT seq, '1=00010001 6=' || repeat('0017', k % 4 + 1) || CASE WHEN k % 5 = 0 THEN '' ELSE ' 39=00' END AS items FROM pulse",
    PULSE,
)
def _opt16(spark, sf):
    k = F.col("k")
    b = g.cat("0001000400010001", "0006", g.sized(F.repeat(F.lit("0017"), k % 4 + 1), 2),
              F.when(k % 5 == 0, F.lit("00270002aa")).otherwise(F.lit("0027000100")))
    return _elements(stage(g.pulse(spark, sf), {"b": F.unhex(b)}), opt16(F.col("b")))


@query(
    "ndp_opts",
    "SELECT seq, '1=0101' || replace(mac, ':', '') || CASE WHEN k % 3 = 0 THEN '' ELSE ' 5=05010000000005dc' END AS items FROM pk",
    PK,
)
def _ndp_opts(spark, sf):
    b = g.cat("0101", g.mac_hex(), F.when(F.col("k") % 3 == 0, F.lit("0500")).otherwise(F.lit("05010000000005dc0302")))
    return _elements(stage(g.pk(spark, sf), {"b": F.unhex(b)}), ndp_opts(F.col("b")))


@query(
    "flags_text",
    """SELECT seq, nullif(CASE WHEN k & 128 <> 0 THEN 'R' ELSE '' END || CASE WHEN k & 64 <> 0 THEN 'S' ELSE '' END
  || CASE WHEN k & 32 <> 0 THEN 'O' ELSE '' END, '') AS flags FROM (SELECT seq, k * 2 AS k FROM pulse)""",
    PULSE,
)
def _flags_text(spark, sf):
    return g.pulse(spark, sf).select("seq", flag_letters(F.col("k") * 2, "RSO").alias("flags"))


@query(
    "flow_key",
    "SELECT src_ip, dst_ip, dport, proto, count(*) AS packets FROM pk GROUP BY ALL",
)
def _flow_key(spark, sf):
    """A flow is its full tuple; grouping never relies on a hash alone."""
    return g.pk(spark, sf).groupBy("src_ip", "dst_ip", "dport", "proto").agg(F.count("*").alias("packets"))


@query(
    "quic_varint",
    """SELECT seq, CASE k % 4 WHEN 0 THEN seq % 64 WHEN 1 THEN seq % 16384 WHEN 2 THEN seq * 1000 ELSE seq * 1000000007 END AS v
FROM pulse""",
    PULSE,
)
def _quic_varint(spark, sf):
    s, k = F.col("seq"), F.col("k")
    b = (
        F.when(k % 4 == 0, g.hx(s % 64, 1)).when(k % 4 == 1, g.hx(s % 16384 + 16384, 2))
        .when((k % 4 == 2) & (s * 1000 < 1 << 30), g.hx(s * 1000 + 2147483648, 4))
        .otherwise(g.hx(F.when(k % 4 == 2, s * 1000).otherwise(s * 1000000007) - F.lit(1 << 62), 8))
    )
    return g.pulse(spark, sf).select("seq", varint_value(F.unhex(g.cat(b, "ffff")), 0).alias("v"))


@query(
    "quic_packet_number",
    """SELECT seq, CASE WHEN c + h <= e THEN c + w WHEN c > e + h AND c >= w THEN c - w ELSE c END AS pn
FROM (SELECT *, e - e % w + t AS c, w // 2 AS h FROM (
  SELECT seq, CAST(power(2, 8 * n) AS BIGINT) AS w, seq * 17 AS e, (seq * 31) % CAST(power(2, 8 * n) AS BIGINT) AS t
  FROM (SELECT seq, k % 4 + 1 AS n FROM pulse)))""",
    PULSE,
)
def _quic_packet_number(spark, sf):
    n = F.col("k") % 4 + 1
    win = F.pow(F.lit(2), n * 8).cast("bigint")
    return g.pulse(spark, sf).select(
        "seq", quic_packet_number(F.col("seq") * 17, (F.col("seq") * 31) % win, n).alias("pn")
    )


HELLO_SQL = """, h AS (
  SELECT seq, k, list_filter([4865 + seq % 3, 2570, 49195 - seq % 5, 4867], lambda x: x <> 2570) AS ciphers,
    CASE WHEN k % 2 = 0 THEN [43] ELSE [] END || [10 + seq % 4, 51, 13] AS exts,
    CASE WHEN k % 4 <> 0 THEN 'shop' || k || '.example.com' END AS sni,
    CASE WHEN k % 3 <> 0 THEN 'h2' END AS alpn, k % 2 = 0 AS v13 FROM pulse),
ja AS (
  SELECT *, 't' || CASE WHEN v13 THEN '13' ELSE '12' END || CASE WHEN sni IS NULL THEN 'i' ELSE 'd' END || '03'
    || lpad(CAST(len(exts) AS VARCHAR), 2, '0') || CASE WHEN alpn IS NULL THEN '00' ELSE 'h2' END || '_'
    || substr(md5(array_to_string(list_transform(ciphers, lambda x: lower(printf('%04x', x))), ',')), 1, 12) || '_'
    || substr(md5(array_to_string(list_transform(list_sort(exts), lambda x: lower(printf('%04x', x))), ',')), 1, 12) AS ja4
  FROM h)
"""


@query(
    "ja4_like",
    HELLO_SQL + "SELECT seq, ja4 FROM ja",
    PULSE,
)
def _ja4_like(spark, sf):
    p = stage(g.pulse(spark, sf), {"b": F.unhex(g.record_hex(g.event_hello(F.col("k"), F.col("seq"))))})
    return stage(p, {"h": tls_client_hello(F.col("b"))}).select("seq", ja4_like(F.col("h")).alias("ja4"))


@query(
    "tls_client_hello",
    HELLO_SQL
    + """SELECT seq, CASE WHEN v13 THEN 772 ELSE 771 END AS version, sni, alpn, len(ciphers) AS n_ciphers,
  array_to_string(exts, ',') AS ext_ids FROM ja""",
    PULSE,
)
def _tls_client_hello(spark, sf):
    p = stage(g.pulse(spark, sf), {"b": F.unhex(g.record_hex(g.event_hello(F.col("k"), F.col("seq"))))})
    return stage(p, {"h": tls_client_hello(F.col("b"))}).select(
        "seq", "h.version", "h.sni", "h.alpn", F.size("h.ciphers").alias("n_ciphers"),
        F.array_join(F.transform("h.ext_ids", lambda x: x.cast("string")), ",").alias("ext_ids"),
    )


def _hmac_sql(inner: str, outer: str, data: str) -> str:
    return f"unhex(sha256({outer} || unhex(sha256({inner} || {data}))))"


def _padded_sql(key: str, pad: str) -> str:
    """One HMAC block of a 32-byte key: the key, filled up with zeros, against a repeated byte."""
    return f"CAST(xor(CAST({key} || unhex(repeat('00', 32)) AS BIT), CAST(unhex(repeat('{pad}', 64)) AS BIT)) AS BLOB)"


def _label_sql(name: str, size: int) -> str:
    full = b"tls13 " + name.encode()
    return f"unhex('{(size.to_bytes(2, 'big') + bytes([len(full)]) + full + bytes([0, 1])).hex()}')"


def _keyed_sql(key: str, name: str, size: int) -> str:
    return _hmac_sql(_padded_sql(key, "36"), _padded_sql(key, "5c"), _label_sql(name, size))


_SALT = bytes.fromhex(V1_SALT).ljust(64, bytes(1))
_SALTED = _hmac_sql(
    f"unhex('{bytes(x ^ 0x36 for x in _SALT).hex()}')", f"unhex('{bytes(x ^ 0x5C for x in _SALT).hex()}')",
    "unhex(printf('%016x', seq))",
)


@query(
    "quic_keys",
    f""", a AS (SELECT seq, {_SALTED} AS prk FROM pulse),
b AS (SELECT seq, {_keyed_sql("prk", "client in", 32)} AS secret FROM a)
SELECT seq, substr(hex({_keyed_sql("secret", "quic key", 16)}), 1, 32) AS "key",
  substr(hex({_keyed_sql("secret", "quic iv", 12)}), 1, 24) AS iv,
  substr(hex({_keyed_sql("secret", "quic hp", 16)}), 1, 32) AS hp FROM b""",
    PULSE,
)
def _quic_keys(spark, sf):
    """Key schedule per connection id."""
    p = g.pulse(spark, sf).withColumn("dcid", F.unhex(g.hx(F.col("seq"), 8)))
    return stage(p, {"q": quic_client_keys(F.col("dcid"))}).select(
        "seq", F.hex("q.key").alias("key"), F.hex("q.iv").alias("iv"), F.hex("q.hp").alias("hp")
    )
