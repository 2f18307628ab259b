"""Request rate limiting: fixed window, quota, cooldown after the quota is used up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators.keyed import components, top_per_group
from tickforge.operators.ranking import global_rank
from tickforge.operators.temporal import asof_lookup, running_sums
from tickforge.session import settle

# Requests per window, window and cooldown in seconds.
MAX_REQUESTS, WINDOW, COOLDOWN = 3, 3600, 4 * 3600
SECONDS_PER_TASK = 1_000_000  # seconds with requests (requests, for coupled identifiers) that may be in one task


def _windows(max_requests: int, window: int, cooldown: int):
    """Step over (identifier, second, count) rows sorted by both: the windows of every identifier.

    Only the open window is carried from batch to batch, and inside a batch the loop jumps from window to
    window by binary search, so an identifier of any size streams through in constant memory.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, until, used = None, None, 0, 0
        for pdf in batches:
            ids, ts, n = pdf["identifier"].to_numpy(), pdf["ts"].to_numpy(), pdf["n"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            closed = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if ids[lo] != who:
                    if start is not None:
                        closed.append((who, start, until))
                    who, start = ids[lo], None
                t, total, i = ts[lo:hi], np.cumsum(n[lo:hi]), 0
                while i < len(t):
                    if start is not None:
                        end = np.searchsorted(t, start + window, side="right")
                        if used < max_requests and end > i:
                            before = total[i - 1] if i else 0
                            quota = np.searchsorted(total, before + max_requests - used)
                            if quota < end:
                                used, until = max_requests, t[quota] + cooldown
                            else:
                                used += total[end - 1] - before
                        i = max(i, end, np.searchsorted(t, until, side="left"))
                        if i >= len(t):
                            break
                        closed.append((who, start, until))
                    start = until = t[i]
                    used = 0
            yield pd.DataFrame(closed, columns=["identifier", "ts", "cooldown_until"])
        if start is not None:
            yield pd.DataFrame([(who, start, until)], columns=["identifier", "ts", "cooldown_until"])
    return fold


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """In one chunk of an identifier: where the path of windows that begins at each second leaves the chunk."""
    pdf = pdf.sort_values("ts")
    ts, leave = pdf["ts"].to_numpy(), pdf["to"].fillna(-1).to_numpy().astype("i8")
    place = np.searchsorted(ts, leave)
    for i in range(len(ts) - 1, -1, -1):
        if leave[i] >= 0 and leave[i] <= ts[-1]:
            leave[i] = leave[place[i]]
    return pd.DataFrame({"identifier": pdf["identifier"].to_numpy(), "ts": ts, "leave": pd.Series(leave, dtype="Int64").where(leave >= 0)})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The windows of one chunk, from the second at which the path enters it."""
    pdf = pdf.sort_values("ts")
    ts, to = pdf["ts"].to_numpy(), pdf["to"].fillna(-1).to_numpy().astype("i8")
    at = np.flatnonzero(pdf["entered"].to_numpy())
    taken = []
    i = int(at[0]) if len(at) else len(ts)
    while i < len(ts):
        taken.append(i)
        i = int(np.searchsorted(ts, to[i])) if to[i] >= 0 else len(ts)
    return pdf.iloc[taken][["identifier", "ts", "cooldown_until"]]


def _split_windows(per_second: DataFrame, max_requests: int, window: int, cooldown: int, chunk: int) -> DataFrame:
    """Windows (identifier, ts, cooldown_until) of identifiers that are too large for one task.

    The window that begins at a second, and so the second at which the next one begins, depends on the requests from
    there on only. These pointers are found for every second by joins, composed inside chunks of ``chunk`` seconds, and
    followed from chunk to chunk by doubling: the steps are the logarithm of the number of chunks, and no group holds
    more than ``chunk`` rows.
    """
    few = per_second.select("identifier", "ts", F.least("n", F.lit(max_requests)).alias("n"))  # more never matter
    numbered = running_sums(few, ["identifier"], "ts", ["n"], suffix="_before", before=True)
    slots = numbered.select("identifier", F.col("ts").alias("quota_ts"), F.explode(F.sequence(
        F.col("n_before") + 1, F.col("n_before") + F.col("n"))).alias("slot"))
    quota = numbered.withColumn("slot", F.col("n_before") + max_requests).join(slots, ["identifier", "slot"], "left")
    full = F.coalesce(F.col("quota_ts") - F.col("ts") <= window, F.lit(False))
    ends = quota.select("identifier", "ts", F.when(full, F.col("quota_ts") + cooldown).otherwise(F.col("ts")).alias("cooldown_until")).withColumn(
        "free", F.greatest(F.col("ts") + window + 1, F.col("cooldown_until")))
    # the first second at or after ``free`` is the last one at or before it when time runs backwards
    back = ends.select("identifier", (-F.col("ts")).alias("t"), "ts")
    found = asof_lookup(ends.select("identifier", (-F.col("free")).alias("t")), back, ["identifier"], "t", ["ts"], "ts")
    nodes = settle(ends.join(found.select("identifier", (-F.col("t")).alias("free"), F.col("ts").alias("to")), ["identifier", "free"], "left").select(
        "identifier", "ts", "to", "cooldown_until", F.floor(F.col("ts") / chunk).alias("chunk")))
    firsts = nodes.groupBy("identifier").agg(F.min("ts").alias("ts"))
    exits = settle(nodes.groupBy("identifier", "chunk").applyInPandas(_exits, "identifier string, ts bigint, leave bigint"))
    entries = exits.filter("leave is not null").select("identifier", F.col("leave").alias("ts")).unionByName(firsts).distinct()
    jumps = settle(exits.join(entries, ["identifier", "ts"], "left_semi").filter("leave is not null"))
    reached = settle(firsts)
    while True:
        further = settle(reached.join(jumps, ["identifier", "ts"]).select("identifier", F.col("leave").alias("ts")))
        if further.isEmpty():
            break
        reached = settle(reached.unionByName(further))
        twice = jumps.select("identifier", F.col("ts").alias("leave"), F.col("leave").alias("end"))
        jumps = settle(jumps.join(twice, ["identifier", "leave"]).select("identifier", "ts", F.col("end").alias("leave")))
    marked = nodes.join(reached.withColumn("entered", F.lit(True)), ["identifier", "ts"], "left").withColumn(
        "entered", F.coalesce("entered", F.lit(False)))
    return marked.groupBy("identifier", "chunk").applyInPandas(_walk, "identifier string, ts bigint, cooldown_until bigint")


def _limiter_windows(requests: DataFrame, max_requests: int, window: int, cooldown: int, rows: int) -> DataFrame:
    """The windows of every identifier: streamed over in one task up to ``rows`` seconds with requests, beyond that split
    into many."""
    per_second = settle(requests.groupBy("identifier", "ts").agg(F.count(F.lit(1)).alias("n")))
    large = settle(per_second.groupBy("identifier").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > rows).select("identifier"))
    fold = _windows(max_requests, window, cooldown)
    fields = "identifier string, ts bigint, cooldown_until bigint"
    if large.isEmpty():
        return per_second.repartition("identifier").sortWithinPartitions("identifier", "ts").mapInPandas(fold, fields)
    small = per_second.join(large, "identifier", "left_anti").repartition("identifier").sortWithinPartitions("identifier", "ts")
    hot = _split_windows(per_second.join(large, "identifier", "left_semi"), max_requests, window, cooldown, 24 * window)
    return small.mapInPandas(fold, fields).unionByName(hot)


def _placed(requests: DataFrame, max_requests: int, window: int, cooldown: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Requests with their window, and the accepted ones (identifier, seq, rn): the first of each window."""
    windows = _limiter_windows(requests, max_requests, window, cooldown, rows)
    found = asof_lookup(requests, windows, ["identifier"], "ts", ["cooldown_until"], "cooldown_until").select(
        "identifier", "ts", F.col("matched_ts").alias("window_start"), "cooldown_until")
    inside = requests.join(found, ["identifier", "ts"]).withColumn("in_window", F.col("ts") - F.col("window_start") <= window)
    accepted = top_per_group(inside.filter("in_window"), ["identifier", "window_start"],
                             [F.col("ts").asc(), F.col("seq").asc()], max_requests)
    return inside, accepted


def rate_limit(requests: DataFrame, max_requests: int = MAX_REQUESTS, window: int = WINDOW, cooldown: int = COOLDOWN,
               rows: int = SECONDS_PER_TASK) -> DataFrame:
    """Decision per request (identifier, ts, seq): allowed, reason, remaining quota, reset time.

    Only accepted requests move the limiter, so a window is found from the number of requests per second:
    requests collapse to one row per (identifier, second) before the shuffle, and windows are found from those.
    Requests then look up their window and only the first ``max_requests`` of a window are ranked. A window that uses up
    its quota starts the cooldown; requests inside it are refused.
    """
    inside, accepted = _placed(requests, max_requests, window, cooldown, rows)
    j = inside.join(accepted.select("identifier", "seq", "rn"), ["identifier", "seq"], "left")
    ok = F.col("rn").isNotNull()
    return j.select(
        "identifier", "ts", "seq", ok.alias("allowed"),
        F.when(~ok & F.col("in_window"), "RATE_LIMIT").when(~ok, "COOLDOWN").alias("reason"),
        F.coalesce(F.lit(max_requests) - F.col("rn"), F.lit(0)).alias("remaining"),
        F.when(ok | F.col("in_window"), F.col("window_start") + window).otherwise(F.col("cooldown_until")).alias("reset_ts"))


def _coupled(max_requests: int, window: int, cooldown: int):
    """Step over (component, address, ip, ts, seq) rows sorted by component, ts, seq: the decision of every request.

    Only the limiters of the open component are carried, from row to row and from batch to batch.
    """
    def meets(at: int, s: tuple[int, int, int] | None) -> str:
        if s is None or (at - s[1] > window and at >= s[2]):
            return "new"
        if at - s[1] > window:
            return "cooling"
        return "more" if s[0] < max_requests else "spent"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, states = None, {}
        for pdf in batches:
            out = []
            for g, address, ip, at in zip(pdf["component"].tolist(), pdf["address"].tolist(), pdf["ip"].tolist(), pdf["ts"].tolist()):
                if g != group:
                    group, states = g, {}
                keys = ("a", address), ("i", ip)
                a, i = states.get(keys[0]), states.get(keys[1])
                ka, ki = meets(at, a), meets(at, i)
                if ka in ("new", "more") and ki in ("new", "more"):
                    for key, kind, s in zip(keys, (ka, ki), (a, i)):
                        used, start = (1, at) if kind == "new" else (s[0] + 1, s[1])
                        states[key] = (used, start, at + cooldown if used == max_requests else 0)
                    a, i = states[keys[0]], states[keys[1]]
                    out.append((True, None, max_requests - max(a[0], i[0]), min(a[1], i[1]) + window))
                elif ka == "spent":
                    out.append((False, "ADDRESS_RATE_LIMIT", 0, a[1] + window))
                elif ki == "spent":
                    out.append((False, "IP_RATE_LIMIT", 0, i[1] + window))
                elif ka == "cooling":
                    out.append((False, "ADDRESS_COOLDOWN", 0, a[2]))
                else:
                    out.append((False, "IP_COOLDOWN", 0, i[2]))
            made = pd.DataFrame(out, columns=["allowed", "reason", "remaining", "reset_ts"], index=pdf.index)
            yield pd.concat([pdf[["address", "ip", "ts", "seq"]], made], axis=1)
    return fold


def both_limits(requests: DataFrame, max_requests: int = MAX_REQUESTS, window: int = WINDOW, cooldown: int = COOLDOWN,
                rows: int = SECONDS_PER_TASK) -> DataFrame:
    """Address and IP limits together, for (address, ip, ts, seq) with a unique seq; addresses compare without case.

    A request passes if both limiters let it pass, and only then does either count it. Requests affect each other only
    inside a component of addresses and IPs that requests connect. Components of up to ``rows`` requests are streamed over
    in time order, each in one task; larger ones are solved as a whole by ``_by_rounds``. Requests without an address or an
    IP are left out.
    """
    r = requests.select(F.lower("address").alias("address"), "ip", "ts", "seq").filter("address IS NOT NULL AND ip IS NOT NULL")
    pairs = settle(r.groupBy("address", "ip").agg(F.count(F.lit(1)).alias("n")))
    named = components(pairs.select(F.concat(F.lit("a"), "address").alias("u"), F.concat(F.lit("i"), "ip").alias("v")))
    of = named.filter(F.col("node").startswith("a")).select(F.substring("node", 2, 2**31 - 1).alias("address"), "component")
    sizes = pairs.groupBy("address").agg(F.sum("n").alias("n")).join(of, "address").groupBy("component").agg(F.sum("n").alias("n"))
    large = settle(of.join(sizes.filter(F.col("n") > rows), "component", "left_semi").select("address"))
    kinds = {f.name: f.dataType.simpleString() for f in r.schema}
    fields = ", ".join([*[f"{c} {kinds[c]}" for c in ("address", "ip", "ts", "seq")],
                        "allowed boolean, reason string, remaining bigint, reset_ts bigint"])
    stepped = lambda some: some.join(of, "address").repartition("component").sortWithinPartitions("component", "ts", "seq").select(
        "component", "address", "ip", "ts", "seq").mapInPandas(_coupled(max_requests, window, cooldown), fields)
    if large.isEmpty():
        return stepped(r)
    hot = _by_rounds(r.join(large, "address", "left_semi"), max_requests, window, cooldown, rows)
    return stepped(r.join(large, "address", "left_anti")).unionByName(hot)


def _by_rounds(requests: DataFrame, max_requests: int, window: int, cooldown: int, rows: int) -> DataFrame:
    """``both_limits`` for components of any size, without a task that holds one.

    Whether a request passes depends on earlier accepted ones only, so the accepted requests are the one set that both
    limiters reproduce: the IP limiter is run over the requests that the address limiter would let pass given the set found
    before, until the set stays.
    Every round settles at least the first request that was decided wrongly.
    """
    settings = (max_requests, window, cooldown, rows)
    ranked = global_rank(requests, [F.col("ts").asc(), F.col("seq").asc()], "pos")
    r = settle(ranked)

    def limited(some: DataFrame, by: str) -> DataFrame:
        """Accepted requests of one limiter: by, pos, and the state that each leaves behind."""
        accepted = _placed(some.select(F.col(by).alias("identifier"), "ts", F.col("pos").alias("seq")), *settings)[1]
        return settle(accepted.select(F.col("identifier").alias(by), F.col("seq").alias("pos"), F.col("rn").alias("used"), "window_start",
                                      F.when(F.col("rn") == max_requests, F.col("ts") + cooldown).otherwise(F.lit(0)).alias("until")))

    def before(accepted: DataFrame, by: str) -> DataFrame:
        """pos and the limiter's state that each request meets: what the last accepted one before it left."""
        points = r.select(by, (F.col("pos") - 1).alias("pos"))
        found = asof_lookup(points, accepted, [by], "pos", ["used", "window_start", "until"], "pos", chunk=4096)
        return found.select(by, (F.col("pos") + 1).alias("pos"), F.struct("used", "window_start", "until").alias(f"{by}_state"))

    def passes(by: str) -> Column:
        s = F.col(f"{by}_state")
        inside = F.col("ts") - s["window_start"] <= window
        return s["used"].isNull() | (inside & (s["used"] < max_requests)) | (~inside & (F.col("ts") >= s["until"]))

    accepted = limited(r, "ip")
    while True:
        met = r.join(before(limited(r.join(accepted.select("pos"), "pos", "left_semi"), "address"), "address"), ["address", "pos"])
        again = limited(met.filter(passes("address")), "ip")
        changed = again.select("pos").exceptAll(accepted.select("pos")).unionByName(accepted.select("pos").exceptAll(again.select("pos")))
        accepted, done = again, changed.isEmpty()
        if done:
            break
    by_address = limited(r.join(accepted.select("pos"), "pos", "left_semi"), "address")
    met = r.join(before(by_address, "address"), ["address", "pos"]).join(before(accepted, "ip"), ["ip", "pos"])
    own = accepted.select("pos", F.col("used").alias("ip_used"), F.col("window_start").alias("ip_start")).join(
        by_address.select("pos", F.col("used").alias("address_used"), F.col("window_start").alias("address_start")), "pos")
    j = met.join(own, "pos", "left")
    ok, a, i = F.col("ip_used").isNotNull(), F.col("address_state"), F.col("ip_state")
    spent = lambda s: (F.col("ts") - s["window_start"] <= window) & (s["used"] >= max_requests)
    rules = [(~passes("address") & spent(a), "ADDRESS_RATE_LIMIT", a["window_start"] + window), (~passes("ip") & spent(i), "IP_RATE_LIMIT", i["window_start"] + window),
             (~passes("address"), "ADDRESS_COOLDOWN", a["until"]), (~passes("ip"), "IP_COOLDOWN", i["until"])]
    reason, reset = F.when(ok, F.lit(None).cast("string")), F.when(ok, F.least("ip_start", "address_start") + window)
    for cond, name, at in rules:
        reason, reset = reason.when(cond, name), reset.when(cond, at)
    return j.select("address", "ip", "ts", "seq", ok.alias("allowed"), reason.alias("reason"),
                    F.when(ok, max_requests - F.greatest("ip_used", "address_used")).otherwise(0).cast("long").alias("remaining"), reset.alias("reset_ts"))
