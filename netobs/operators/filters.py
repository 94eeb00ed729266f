"""Frame prefilter, endpoint filter text, MAC exclusions, vector routing."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.functions.addr import any_of, cidr_bounds
from netobs.functions.bytes import bits, u8, u16
from netobs.operators import decode as d

# Ports of interest.
TCP_PORTS = (80, 8080, 443)
UDP_PORTS = (67, 137, 1900, 3702, 5353, 53)


def interest_prefilter(frames: DataFrame) -> DataFrame:
    """Keep frame classes that can produce a record; Ethernet only.

    Works on raw bytes, so it goes in front of the decoder.
    """
    b, n = F.col("data"), F.length("data")
    eth_type = u16(b, 12)
    wholesale = eth_type.isin(
        d.ETH_ARP, d.ETH_LLDP, *d.VLAN_TPIDS, d.PPPOE_SESSION, d.ETH_IPV6
    )
    ihl = bits(u8(b, 14), 15) * 4
    l4 = ihl + 14
    sport, dport = u16(b, l4), u16(b, l4 + 2)
    # A byte that is not there rejects the frame, as a short load does in a packet filter.
    tcp_control = (n > l4 + 13) & (bits(u8(b, l4 + 13), d.FIN | d.SYN | d.RST) != 0)
    tcp_data = (
        (n > l4 + 13)
        & (u16(b, 16) > ihl + F.shiftright(bits(u8(b, l4 + 12), 240), 2))
        & dport.isin(*TCP_PORTS)
    )
    udp = (n >= l4 + 4) & (dport.isin(*UDP_PORTS, 443) | sport.isin(*UDP_PORTS))
    proto = u8(b, 23)
    ipv4 = (eth_type == d.ETH_IPV4) & (
        F.when(proto == d.TCP, tcp_control | tcp_data).when(proto == d.UDP, udp).otherwise(F.lit(False))
    )
    return frames.where((F.col("link_type") != "ethernet") | ((n >= 14) & (wholesale | ipv4)))


# -- endpoint filter text -------------------------------------------------------

_MAC = re.compile(r"[0-9a-fA-F]{1,2}(:[0-9a-fA-F]{1,2}){5}")
_WORDS = {"and": "AND", "or": "OR", "not": "NOT", "&&": "AND", "||": "OR", "!": "NOT"}


def parse_mac(text: str) -> bytes:
    if not _MAC.fullmatch(text):
        raise ValueError(f"not a MAC address: {text}")
    return bytes(int(p, 16) for p in text.split(":"))


def _literal(token: str) -> str:
    """SQL predicate of one address literal: true for either end of the packet."""
    if _MAC.fullmatch(token):
        mac = parse_mac(token).hex()
        return f"(src_mac = X'{mac}' OR dst_mac = X'{mac}')"
    address, _, bits_text = token.partition("/")
    try:
        if "%" in token:
            raise ValueError(token)
        ip = ipaddress.ip_address(address)
        if "/" in token and not re.fullmatch(r"\+?\d+", bits_text):
            raise ValueError(token)
        net = f"{ip}/{int(bits_text)}" if "/" in token else str(ip)
        family, lo, hi, _ = cidr_bounds(net)
    except ValueError:
        raise ValueError(f"unrecognized filter token: {token}") from None
    if family == 6:
        test = "coalesce({c} BETWEEN X'%s' AND X'%s' AND length({c}) = 16, false)" % (lo.hex(), hi.hex())
    else:
        # packets that are not IPv4 compare as 0.0.0.0
        test = (
            "(CASE WHEN length({c}) = 4 THEN {c} ELSE X'00000000' END BETWEEN X'%s' AND X'%s')"
            % (lo.hex(), hi.hex())
        )
    return "(" + " OR ".join(test.format(c=c) for c in ("src_ip", "dst_ip")) + ")"


def _tokens(text: str) -> list[str]:
    """Parentheses, a leading ``!``, ``&&``, ``||`` and blank-separated words."""
    return re.findall(r"\(|\)|!(?!=)|&&|\|\||[^\s()]+", text)


def _well_formed(tokens: list[str]) -> bool:
    """Operands and operators in turn, brackets in pairs."""
    depth, wants_operand = 0, True
    for token in tokens:
        word = _WORDS.get(token.lower())
        if wants_operand:
            if token == "(":
                depth += 1
            elif token == ")" or word in ("AND", "OR"):
                return False
            elif word is None:
                wants_operand = False
        elif token == ")" and depth:
            depth -= 1
        elif word in ("AND", "OR"):
            wants_operand = True
        else:
            return False
    return not wants_operand and not depth


def endpoint_filter(text: str) -> Column:
    """Boolean column of a filter such as ``10.0.0.0/8 and not 02:00:00:00:00:01``.

    The words are mapped to SQL, whose parser has the same precedence: not, and, or.
    """
    tokens = _tokens(text)
    if not [t for t in tokens if t not in "()"]:
        raise ValueError("empty filter")
    if not _well_formed(tokens):
        raise ValueError(f"filter does not parse: {text}")
    return F.expr(" ".join(t if t in "()" else _WORDS.get(t.lower()) or _literal(t) for t in tokens))


def exclude_filter(packets: DataFrame, text: str | None) -> DataFrame:
    return packets.where(~endpoint_filter(text)) if text else packets


def target_filter(packets: DataFrame, text: str | None) -> DataFrame:
    return packets.where(endpoint_filter(text)) if text else packets


# -- MAC exclusions -------------------------------------------------------------


def _mac_list(macs: list[str] | tuple[str, ...]) -> list[bytes]:
    return [parse_mac(m) for m in macs]


def _src_listed(macs) -> Column:
    listed = _mac_list(macs)
    return F.col("src_mac").isin(*listed) if listed else F.lit(False)


def hard_mac_exclusion(packets: DataFrame, macs=()) -> DataFrame:
    """Drop outbound Ethernet packets of the listed source MACs."""
    return packets.where(
        ~((F.col("link_type") == "ethernet") & _src_listed(macs) & F.col("is_outbound"))
    )


def router_mac_exclusion(packets: DataFrame, macs=()) -> DataFrame:
    """Drop router frames but for DNS answers and inbound SYN+ACK."""
    b, off, n = F.col("data"), F.col("l4_off"), F.length("data")
    dns_answer = (F.col("proto") == d.UDP) & (n >= off + 8) & (u16(b, off) == 53)
    flags = u8(F.col("l4"), 13)
    synack = (
        ~F.col("is_outbound")
        & (F.col("proto") == d.TCP)
        & (F.length("l4") >= 20)
        & (bits(flags, d.SYN | d.ACK) == (d.SYN | d.ACK))
    )
    allowed = F.coalesce(dns_answer | synack, F.lit(False))
    return packets.where(
        ~((F.col("link_type") == "ethernet") & _src_listed(macs) & ~allowed)
    )


# -- routing to vectors -----------------------------------------------------------


def tcp_relevant(groups: set[str] | frozenset[str] = frozenset("sht")) -> Column:
    """Segments that some selected vector reads."""
    tests: list[Column] = []
    if "s" in groups:
        tests.append(bits(F.col("flags"), d.SYN | d.RST | d.FIN) != 0)
    if "h" in groups:
        tests.append(F.col("dport").isin(80, 8080))
    if "t" in groups:
        tests.append(F.col("dport") == 443)
    return any_of(tests)


def udp_vector(groups: set[str] | frozenset[str] = frozenset("dnmqt")) -> Column:
    """Vector of a datagram: the first selected group whose ports match, else NULL."""
    sport, dport = F.col("sport"), F.col("dport")
    v6 = F.col("ip_version") == 6

    def either(*ports: int) -> Column:
        return sport.isin(*ports) | dport.isin(*ports)

    chain: list[tuple[str, str, Callable[[], Column]]] = [
        ("d", "DHCP6", lambda: v6 & (sport == 546) & (dport == 547)),
        ("d", "DHCP", lambda: ~v6 & either(67)),
        ("n", "NBNS", lambda: either(137)),
        ("m", "L7", lambda: either(1900, 3702)),
        ("m", "MDNS", lambda: either(5353)),
        ("q", "DNS", lambda: either(53)),
        ("t", "QUIC", lambda: dport == 443),
    ]
    out = F.lit(None).cast("string")
    for group, name, test in reversed(chain):
        if group in groups:
            out = F.when(test(), F.lit(name)).otherwise(out)
    return out
