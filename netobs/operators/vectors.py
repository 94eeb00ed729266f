"""Selection of record groups by letters."""

from __future__ import annotations

from dataclasses import dataclass

# Letter to record tags.
GROUPS: dict[str, tuple[str, ...]] = {
    "s": ("SYN", "SYNACK"),
    "m": ("L7", "MDNS"),
    "d": ("DHCP", "DHCP6"),
    "n": ("NBNS",),
    "q": ("DNS",),
    "h": ("HTTP",),
    "t": ("TLS", "QUIC"),
    "l": ("LLDP", "ARP", "NDP", "RA"),
}
EXTENDED: dict[str, tuple[str, ...]] = {"s": ("TCPLVL",), "q": ("DNSEXT", "ALERT")}


@dataclass(frozen=True)
class Selection:
    """Chosen groups; ``raw`` ones are not deduplicated."""

    groups: frozenset[str]
    raw: frozenset[str]
    ipv6: bool
    extended: bool = False  # handshake times, DNS latency and entropy
    quic_stateful: bool = False

    @property
    def tags(self) -> list[str]:
        out: list[str] = []
        for g, names in GROUPS.items():
            if g in self.groups:
                out += names
                if self.extended:
                    out += EXTENDED.get(g, ())
        return out

    def deduplicated(self, tag: str) -> bool:
        for g in GROUPS:
            if tag in GROUPS[g] or tag in EXTENDED.get(g, ()):
                return g not in self.raw
        raise KeyError(tag)


def vectors(
    *letters: str,
    extended: bool = False,
    quic_stateful: bool = False,
    ipv6: bool = False,
    iface: str | None = None,
) -> Selection:
    """``vectors("s", "M")`` or ``vectors("sM")``; upper case turns deduplication off.

    ``a`` / ``A`` choose everything, as does a positional interface; ``v`` adds
    IPv6; nothing at all means s, m, d, n with IPv6.
    """
    groups: set[str] = set()
    raw: set[str] = set()
    for letter in "".join(letters):
        low = letter.lower()
        if low == "v":
            ipv6 = True
        elif low == "a":
            ipv6 = True
            groups = set(GROUPS)
            raw = set(GROUPS) if letter == "A" else set()
        elif low in GROUPS:
            groups.add(low)
            (raw.add if letter.isupper() else raw.discard)(low)
        else:
            raise ValueError(f"unknown vector letter: {letter}")
    if iface is not None:
        groups, raw, ipv6 = set(GROUPS), set(), True
    if not groups:
        groups, raw, ipv6 = set("smdn"), set(), True
    return Selection(frozenset(groups), frozenset(raw), ipv6, extended, quic_stateful)
