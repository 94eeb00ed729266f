"""Stateful operators on streams: the rules of ``operators`` with state across micro-batches.

Every operator judges the rows of a key in event-time order (``in_order``), so it
gives the rows of its batch form. ``delay`` is how long rows may be late; None
stands for rows that carry a watermark already, as those of another operator do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netobs.functions.quic import nearest_number
from netobs.operators.dedup import DEFAULT_TTL, REFRESH_FLOORS, refresh_ttl, wire_signature
from netobs.plans.stage import stage
from netobs.streaming.hello import HelloParts
from netobs.streaming.inorder import DELAY, Rule, in_order

SECOND = 1_000_000
LONG_AGO = -(1 << 60)


# -- F1, F2: repeated records ---------------------------------------------------------


def sliding(us: np.ndarray, ttl: int, held: dict) -> tuple[np.ndarray, dict]:
    sec = us // SECOND
    before = np.concatenate([[held.get("last") if held.get("last") is not None else LONG_AGO], sec[:-1]])
    return np.flatnonzero(sec - before >= ttl), {"last": int(sec[-1])}


def fixed(us: np.ndarray, ttl: int, held: dict) -> tuple[np.ndarray, dict]:
    sec, kept, at = us // SECOND, [], 0
    anchor = held.get("last")
    while True:  # from one kept row to the next that can be kept
        if anchor is not None:
            at = int(np.searchsorted(sec, anchor + ttl))
        if at >= len(sec):
            return np.array(kept, np.int64), {"last": anchor}
        kept.append(at)
        anchor = int(sec[at])


def suppression(ttl: int | None = None, refresh: bool | None = None) -> Rule:
    """One window for all rows, or that of each key's rows (``_ttl, _fixed``)."""

    def rule(us: np.ndarray, columns: dict, held: dict):
        wait = columns["_ttl"][0] if ttl is None else ttl
        way = fixed if (columns["_fixed"][0] if refresh is None else refresh) else sliding
        at, after = way(us, wait, held)
        return at, {}, after

    return rule


def dedup_sliding(rows: DataFrame, keys: list[str], ttl: int, delay: str | None = DELAY) -> DataFrame:
    """Keep a row when its key was not seen in the ``ttl`` seconds before it."""
    return in_order(rows, keys, suppression(ttl, False), state="last long", idle=ttl, delay=delay)


def dedup_refresh(rows: DataFrame, keys: list[str], ttl: int, delay: str | None = DELAY) -> DataFrame:
    """Keep the first row of a key, then the first one ``ttl`` seconds or more after the last kept."""
    return in_order(rows, keys, suppression(ttl, True), state="last long", idle=ttl, delay=delay)


def dedup_by_row(
    rows: DataFrame, keys: list[str], ttl: Column, refresh: Column, most: int, at_once: Column | None = None, delay: str | None = DELAY,
) -> DataFrame:
    """Both rules in one operator and one state store: window and kind are those of a key's rows.

    ``most`` is the longest window; rows with ``at_once`` are not suppressed.
    """
    named = rows.withColumns({"_ttl": ttl.cast("long"), "_fixed": refresh})
    return in_order(
        named, keys, suppression(), "_ttl long, _fixed boolean", state="last long", idle=most, at_once=at_once, delay=delay,
        gone=("_ttl", "_fixed"),
    )


def dedup_wire(wire: DataFrame, ttl: int = DEFAULT_TTL, delay: str | None = DELAY) -> DataFrame:
    """Suppress repeats among parsed wire records of all tags, each by its own key and window."""
    rows = stage(wire.where(F.col("reject").isNull()), {"_sig": wire_signature()})
    rows = rows.withColumn("_routed", F.col("routed") & (F.col("tag") != "LLDP"))
    window = F.lit(ttl)
    for tag in REFRESH_FLOORS:
        window = F.when(F.col("tag") == tag, F.lit(refresh_ttl(tag, ttl))).otherwise(window)
    kept = dedup_by_row(
        rows, ["sensor_name", "tag", "mac", "_sig", "_routed"], window, F.col("tag").isin(*REFRESH_FLOORS),
        max(ttl, *(refresh_ttl(t, ttl) for t in REFRESH_FLOORS)), delay=delay,
    )
    return kept.drop("_sig", "_routed")


# -- F3, F4, F9: the last row of another kind ------------------------------------------


def last_value(ttl: int, out: str) -> Rule:
    def rule(us: np.ndarray, columns: dict, held: dict):
        sec, claim = us // SECOND, np.array(columns["_right"], bool)
        at = np.maximum.accumulate(np.where(claim, np.arange(len(us)), -1))
        at = np.concatenate([[-1], at[:-1]])  # rows before this one
        when = np.where(at >= 0, sec[at], held.get("sec") if held.get("sec") is not None else LONG_AGO)
        left = np.flatnonzero(~claim)
        values = columns["_value"]
        found = [(values[at[i]] if at[i] >= 0 else held.get("value")) if sec[i] - when[i] <= ttl else None for i in left]
        if claim.any():
            i = int(np.flatnonzero(claim)[-1])
            held = {"sec": int(sec[i]), "value": values[i]}
        return left, {out: found}, held

    return rule


def last_before(
    left: DataFrame, right: DataFrame, keys: list[str], value: str, ttl: int, out: str,
    salts: int = 1, at_once: Column | None = None, delay: str | None = DELAY,
) -> DataFrame:
    """Add ``out``: ``value`` of the key's last ``right`` row at most ``ttl`` seconds old, else NULL.

    A left and a right row of the same ``(ts, seq)`` count in this order. A busy
    key's left rows are dealt to ``salts`` states, its right rows, which are few,
    go to all of them. Left rows with ``at_once`` have no match.
    """
    kind = right.schema[value].dataType.simpleString()
    if delay is not None:
        left, right = left.withWatermark("ts", delay), right.withWatermark("ts", delay)
    asks = left.withColumns({"_right": F.lit(False), "_salt": F.pmod(F.xxhash64("ts", "seq"), F.lit(salts)).cast("int")})
    asks = asks.withColumn("_now", F.lit(False) if at_once is None else F.coalesce(at_once, F.lit(False)))
    claims = right.select(*keys, "ts", "seq", F.col(value).cast("string").alias("_value")).withColumns(
        {"_right": F.lit(True), "_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), "_now": F.lit(False)}
    )
    both = asks.unionByName(claims, allowMissingColumns=True).withColumn("_side", F.col("_right").cast("int"))
    hit = in_order(
        both, [*keys, "_salt"], last_value(ttl, "_found"), "_right boolean, _value string", "_found string", "sec long, value string",
        idle=ttl, order=("seq", "_side"), at_once=F.col("_now"), delay=None, gone=("_right", "_value", "_now"),
    )
    return hit.select(*left.columns, F.col("_found").cast(kind).alias(out))


PACKET_SALTS = 4


def owner_asof(
    packets: DataFrame, claims: DataFrame, keys: tuple[str, ...] = ("ip",), mac: str = "mac",
    owner: str = "owner_mac", ttl: int = 180, out: str = "mismatch",
    salts: int = PACKET_SALTS, at_once: Column | None = None, delay: str | None = DELAY,
) -> DataFrame:
    """Add ``out``: the last claim within ``ttl`` seconds names another MAC."""
    hit = last_before(packets, claims, list(keys), owner, ttl, "_own", salts, at_once, delay)
    return hit.withColumn(out, F.coalesce(F.col("_own") != F.col(mac), F.lit(False))).drop("_own")


def routed_flag(packets: DataFrame, claims: DataFrame, ask: Column, ttl: int = 180, delay: str | None = DELAY) -> DataFrame:
    """Add ``routed``: off-link source, or a judged sender (``ask``) that is not the recorded owner.

    Addresses are compared as text, in which form they can be kept in the state.
    Packets that are not judged do not wait for the watermark.
    """
    text = packets.withColumns({"ip": F.hex("src_ip"), "mac": F.hex("src_mac"), "_ask": F.coalesce(ask, F.lit(False))})
    known = claims.select("ts", "seq", F.hex("ip").alias("ip"), F.hex("owner_mac").alias("owner_mac"))
    flagged = owner_asof(text, known, ttl=ttl, at_once=~F.col("_ask"), delay=delay)
    return flagged.withColumn("routed", F.col("offlink_routed") | F.col("mismatch")).drop("ip", "mac", "_ask", "mismatch")


def failure_gate(failures: DataFrame, successes: DataFrame, keys: list[str], ttl: int = 15, delay: str | None = DELAY) -> DataFrame:
    """Drop failures of a flow that succeeded ``ttl`` seconds ago or less."""
    hit = last_before(failures, successes.withColumn("_ok", F.lit(True)), keys, "_ok", ttl, "_s", delay=delay)
    return hit.where(F.col("_s").isNull()).drop("_s")


# -- F5: handshakes -------------------------------------------------------------------


def handshakes(ttl: int) -> Rule:
    """Entries of a connection by the client's side; ``_from`` is the text of the row that opened one."""
    limit = ttl * SECOND

    def rule(us: np.ndarray, columns: dict, held: dict):
        entries = {client: (since, row) for client, since, row in held.get("entries") or []}
        at, rtt, opened = [], [], []
        for i, (t, kind, forward, back) in enumerate(zip(us.tolist(), columns["kind"], columns["_fwd"], columns["_rev"], strict=True)):
            if kind == "SYN":
                if forward not in entries or t - entries[forward][0] > limit:
                    entries[forward] = (t, columns["_row"][i])
                continue
            # A FIN or RST that fits both readings counts once, as the client's.
            for client in (back,) if kind == "SYNACK" else (forward, back):
                since, row = entries.get(client, (LONG_AGO, None))
                if t - since <= limit and (kind != "SYNACK" or t > since):
                    at.append(i)
                    rtt.append(t - since if kind == "SYNACK" else 0)
                    opened.append(row)
                    break
            if kind == "SYNACK":
                entries.pop(back, None)
        live = [(client, since, row) for client, (since, row) in entries.items() if us[-1] - since <= limit]
        return np.array(at, np.int64), {"rtt_us": rtt, "_from": opened}, {"entries": live}

    return rule


HANDSHAKE_STATE = "entries array<struct<client: string, since: long, row: string>>"


def opener(row: str | Column, like: DataFrame, fields: tuple[str, ...]) -> list[Column]:
    """Columns ``fields`` of the row text that a rule kept."""
    shape = StructType([like.schema[c] for c in fields])
    whole = F.from_json(row, shape)
    return [whole[c].alias(c) for c in fields]


def tcp_handshake(
    events: DataFrame, keys: list[str], ttl: int = 120, carry: tuple[str, ...] = (),
    forward: Column | None = None, back: Column | None = None, delay: str | None = DELAY,
) -> DataFrame:
    """Handshake and state records from ``SYN, SYNACK, FIN, RST`` events.

    ``keys`` are the connection's, the same for both directions; ``forward`` names
    the client if the sender is it, ``back`` if the receiver is. Each event is one
    row, read both ways where it may be either. Without the two, ``keys`` are the
    client's alone. ``carry`` columns are those of the opening SYN.
    """
    named = events.withColumns({"_fwd": F.lit("") if forward is None else forward, "_rev": F.lit("") if back is None else back})
    hit = in_order(
        named, keys, handshakes(ttl), "kind string, _fwd string, _rev string", "rtt_us long, _from string", HANDSHAKE_STATE,
        idle=ttl, delay=delay, gone=("_fwd", "_rev"),
    )
    first = opener("_from", events, carry) if carry else []
    return hit.select("ts", "seq", *keys, *first, F.col("kind").alias("state_event"), "rtt_us")


# -- F6: DNS latency --------------------------------------------------------------------


def latencies(timeout: float) -> Rule:
    limit = int(timeout * SECOND)

    def rule(us: np.ndarray, columns: dict, held: dict):
        answer = np.array(columns["is_response"], bool)
        asked = np.concatenate([[held.get("us") if held.get("us") is not None else LONG_AGO], us[:-1]])
        was = np.concatenate([[held.get("resp") if held.get("resp") is not None else True], answer[:-1]]).astype(bool)
        rows = [held.get("row"), *columns["_row"]]
        at = np.flatnonzero(answer & ~was & (us - asked < limit))
        after = {"us": int(us[-1]), "resp": bool(answer[-1]), "row": None if answer[-1] else rows[-1]}
        return at, {"latency_us": (us - asked)[at].tolist(), "_from": [rows[i] for i in at]}, after

    return rule


LATENCY_STATE = "us long, resp boolean, row string"


def dns_latency(messages: DataFrame, keys: list[str], timeout: float = 5, carry: tuple[str, ...] = (), delay: str | None = DELAY) -> DataFrame:
    """Responses that answer the message before them, when that is a query under ``timeout`` seconds old."""
    hit = in_order(
        messages, keys, latencies(timeout), "is_response boolean", "latency_us long, _from string", LATENCY_STATE,
        idle=int(timeout) + 1, delay=delay,
    )
    kept = [c for c in messages.columns if c not in carry]
    return hit.select(*kept, "latency_us", *(opener("_from", messages, carry) if carry else []))


# -- F7: flow budget ----------------------------------------------------------------------


def budgets(idle: int, budget: int) -> Rule:
    """Rows with ``_record`` belong to the packet before them and share its fate."""

    def rule(us: np.ndarray, columns: dict, held: dict):
        at = []
        last, n, done, open_ = held.get("sec"), held.get("n") or 0, held.get("done") or False, bool(held.get("open"))
        for i, (sec, whole, record) in enumerate(zip((us // SECOND).tolist(), columns["_complete"], columns["_record"], strict=True)):
            if not record:
                if last is None or sec - last > idle:
                    n, done = 0, False
                n, open_ = n + 1, n < budget and not done
                last, done = sec, done or bool(whole)
            if open_:
                at.append(i)
        return np.array(at, np.int64), {}, {"sec": last, "n": n, "done": done, "open": open_}

    return rule


BUDGET_STATE = "sec long, n long, done boolean, open boolean"


def app_flow_budget(packets: DataFrame, keys: list[str], complete: str = "complete", idle: int = 60, budget: int = 8, delay: str | None = DELAY) -> DataFrame:
    """Keep a packet while its flow episode is young and unfinished."""
    named = packets.withColumns({"_complete": F.col(complete), "_record": F.lit(False)})
    return in_order(
        named, keys, budgets(idle, budget), "_complete boolean, _record boolean", state=BUDGET_STATE, idle=idle, delay=delay,
        gone=("_complete", "_record"),
    )


# -- F8: capture losses ------------------------------------------------------------------


def losses(interval: int) -> Rule:
    def rule(us: np.ndarray, columns: dict, held: dict):
        slot = us // SECOND // interval
        sums = pd.DataFrame({"packets": columns["packets"], "drops": columns["drops"]}).groupby(slot).sum()
        if held.get("slot") is not None:
            sums = sums.add(pd.DataFrame({"packets": held["packets"], "drops": held["drops"]}, index=[held["slot"]]), fill_value=0).astype("int64").sort_index()
        closed, last = sums.iloc[:-1], sums.iloc[-1]
        before = {c: held.get(f"total_{c}") or 0 for c in ("packets", "drops")}
        total = closed.cumsum() + [before["packets"], before["drops"]]
        lost = closed["drops"] > 0
        after = {"slot": int(sums.index[-1]), **{c: int(last[c]) for c in before}, **{f"total_{c}": int(total[c].iloc[-1]) if len(total) else before[c] for c in before}}
        out = {"_slot": closed.index[lost].tolist(), "_packets": closed["packets"][lost].tolist(), "_drops": closed["drops"][lost].tolist(),
               "total_packets": total["packets"][lost].tolist(), "total_drops": total["drops"][lost].tolist()}
        # Any row of the key carries the closed intervals; their times follow from the slot.
        return np.zeros(int(lost.sum()), np.int64), out, after

    return rule


def drop_report(stats: DataFrame, interval: int = 10, keys: tuple[str, ...] = ("iface",), delay: str | None = DELAY) -> DataFrame:
    """Intervals with losses, each as soon as a row of a later interval is judged.

    Rows are summed up by interval before any state sees them, so a state has one
    row per interval, however many an interface's counters have. Totals run over
    the whole stream, so an interface's state stays.
    """
    if delay is not None:
        stats = stats.withWatermark("ts", delay)
    sums = stats.groupBy(F.window("ts", f"{interval} seconds").alias("_w"), *keys).agg(F.sum("packets").alias("packets"), F.sum("drops").alias("drops"))
    ranked = sums.select(F.window_time("_w").alias("ts"), *keys, "packets", "drops", F.lit(0).alias("_n"))
    closed = in_order(
        ranked, list(keys), losses(interval), "packets long, drops long",
        "_slot long, _packets long, _drops long, total_packets long, total_drops long",
        "slot long, packets long, drops long, total_packets long, total_drops long",
        idle=None, order=("_n",), delay=None, gone=("packets", "drops"), chained=False,
    )
    share = F.round(F.lit(100.0) * F.col("_drops") / F.greatest("_packets", F.lit(1)), 2)
    return closed.select(
        F.timestamp_seconds(F.col("_slot") * interval).alias("ts"), *keys, F.col("_packets").alias("packets"),
        F.col("_drops").alias("drops"), share.alias("drop_pct"), "total_packets", "total_drops",
    )


# -- G6, G7: packet numbers and ClientHello reassembly ----------------------------------------


def hellos(idle: int, numbered: bool) -> Rule:
    """Packets that complete a hello, and with ``numbered`` also those that fail.

    A numbered packet counts when the number it verifies under (``_full``, -1 for
    none) is its own truncated one or the nearest to the largest number so far. Of
    the packets of a datagram that fail, the first is let go, and none when the
    datagram completes a hello.
    """

    def rule(us: np.ndarray, columns: dict, held: dict):
        machine = HelloParts(idle)
        machine.load(held.get("last"), held.get("parts") or [])
        largest = held.get("largest")
        at, out = [], []
        datagram, failed, done = None, False, False
        for i, t in enumerate(us.tolist()):
            if numbered:
                if (t, columns["seq"][i]) != datagram:
                    datagram, failed, done = (t, columns["seq"][i]), False, False
                full, pn = columns["_full"][i], columns["_pn"][i]
                near = nearest_number(0 if largest is None else largest + 1, pn, columns["_size"][i])
                if full < 0 or full not in (pn, near):
                    if not failed and not done:
                        at.append(i)
                        out.append(None)
                    failed = True
                    continue
                largest = full
            hello = machine.add(t // SECOND, columns["frags"][i])
            if hello is not None:
                if numbered and failed and out and out[-1] is None and us[at[-1]] == t and columns["seq"][at[-1]] == columns["seq"][i]:
                    at.pop()
                    out.pop()
                if not done:
                    at.append(i)
                    out.append(hello)
                done = numbered
        last, parts = machine.dump()
        return np.array(at, np.int64), {"_hello": out}, {"last": last, "parts": parts, "largest": largest}

    return rule


HELLO_STATE = "last long, parts array<struct<off: int, bytes: binary>>, largest long"
FRAGMENTS = "frags array<struct<off: int, bytes: binary>>"


def quic_reassemble(fragments: DataFrame, keys: list[str], idle: int = 5, out: str = "hello", delay: str | None = DELAY) -> DataFrame:
    """Rows that complete a hello; ``frags`` and ``part`` as in the batch form."""
    done = in_order(
        fragments, keys, hellos(idle, False), FRAGMENTS, "_hello binary", HELLO_STATE, idle=idle, order=("seq", "part"), delay=delay,
        gone=("frags",),
    )
    return done.withColumnRenamed("_hello", out)


def quic_stateful(packets: DataFrame, keys: list[str], idle: int = 5, delay: str | None = DELAY) -> DataFrame:
    """Initial packets that complete a hello (``hello``) or do not verify (NULL there).

    ``packets`` has ``part``, ``_pn`` and ``_size`` (truncated number and its
    bytes), ``_full`` (the number it verifies under, -1 for none) and ``frags``.
    Packets of one datagram with different connection ids fail apart.
    """
    done = in_order(
        packets, keys, hellos(idle, True), f"_pn long, _size int, _full long, {FRAGMENTS}", "_hello binary", HELLO_STATE,
        idle=idle, order=("seq", "part"), delay=delay, gone=("_pn", "_size", "_full", "frags"),
    )
    return done.withColumnRenamed("_hello", "hello")
