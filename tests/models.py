"""The trackers as plain loops over one boot's records in order, to hold the Spark forms against."""

from __future__ import annotations

from collections import defaultdict


def charging(records):
    state, out = "UNKNOWN", []
    for r in records:
        if r.kind == "health":
            state = "CHARGING" if r.values["chg"] == "" else "UNPLUGGED"
        out.append((r.token, state))
    return out


def suspend(records):
    state, out = "UNKNOWN", []
    for r in records:
        if r.kind == "power":
            state = {"entry": "SUSPENDED", "exit": "AWAKE"}[r.values["power"]]
        out.append((r.token, state))
    return out


def fgbg(records, delay=1_000_000):
    state, waiting, since, lines, changes = "UNKNOWN", False, None, [], []
    for r in records:
        if r.kind == "fg":
            if r.values["pid"]:
                changes.append((r.token, state, "FOREGROUND"))
                state, waiting = "FOREGROUND", False
            else:
                waiting, since = True, r.trace_us
        if waiting and r.trace_us - since > delay:
            changes.append((r.token, state, "BACKGROUND"))
            state, waiting = "BACKGROUND", False
        lines.append((r.token, state))
    return lines, changes


def cpu_states(records):
    state, freq, out = defaultdict(lambda: "UNKNOWN"), defaultdict(int), []
    for r in records:
        if r.kind not in ("freq", "hotplug"):
            continue
        cpu = r.values["cpu"]
        old = state[cpu], freq[cpu]
        if r.kind == "freq":
            state[cpu], freq[cpu] = "ONLINE", r.values["freq"]
        elif r.values["error"] == 0 and r.values["word"] in ("online", "offline"):
            state[cpu] = r.values["word"].upper()
        out.append((r.token, cpu, state[cpu], freq[cpu], *old))
    return out


def freq_spans(records):
    freq, since, out = defaultdict(int), {}, []
    for r in records:
        v = r.values
        if r.kind == "freq" or (r.kind == "hotplug" and v["word"] == "offline"):
            if freq[v["cpu"]]:
                out.append((r.token, v["cpu"], freq[v["cpu"]], r.trace_us - since[v["cpu"]]))
        if r.kind == "freq":
            freq[v["cpu"]], since[v["cpu"]] = v["freq"], r.trace_us
    return out


def combinations(records):
    state, freq, start, out = ["?"] * 4, [-1] * 4, None, []
    for r in records:
        if r.kind not in ("freq", "hotplug") or r.values.get("error", 0):
            continue
        if "?" not in state and all(s == "offline" or f != -1 for s, f in zip(state, freq)):
            key = "-".join(sorted(str(f) for s, f in zip(state, freq) if s == "online"))
            out.append((r.token, key, r.trace_us - start))
            start = r.trace_us
        cpu = r.values["cpu"]
        if r.kind == "freq":
            freq[cpu] = r.values["freq"]
            state[cpu] = "online" if state[cpu] == "?" else state[cpu]
        elif r.values["word"] in ("online", "offline"):
            state[cpu] = r.values["word"]
            freq[cpu] = -1 if state[cpu] == "offline" else freq[cpu]
        start = r.trace_us if start is None else start
    return out


def ncpu_spans(records):
    last, out = None, []
    for r in records:
        if r.kind == "ncpu":
            if last:
                out.append((r.token, last.values["n"], r.trace_us - last.trace_us))
            last = r
    return out


def sessions(records):
    """(cpu, start token, end token, counters, total, busy, background busy) per closed session."""
    open_, out = {}, []
    for r in records:
        cpu = r.values.get("cpu")
        if r.kind == "marker" and r.values["marker"] == "BEGIN":
            open_.setdefault(cpu, (r.token, []))
        elif r.kind == "marker" and cpu in open_:
            start, infos = open_.pop(cpu)
            busy = [i for i in infos if "swapper" not in i["comm"]]
            out.append((cpu, start, r.token, len(infos), sum(i["rtime"] for i in infos),
                        sum(i["rtime"] for i in busy), sum(i["bg"] for i in busy)))
        elif r.kind == "info" and cpu in open_:
            open_[cpu][1].append(r.values)
    return out


def histogram(records):
    pid, out = 0, defaultdict(int)
    for r in records:
        if r.kind == "fg":
            pid = r.values["pid"]
        if r.kind == "temp" and pid:
            out[r.values["temp"]] += 1
    return dict(out)


def chunks(records):
    """(start token, end token, tokens of the lines between) per closed chunk."""
    level, start, data, out = None, None, [], []
    first = True
    for r in records:
        if r.kind != "health":
            if start is not None:
                data.append(r.token)
            continue
        here, chg = r.values["l"], r.values["chg"]
        if first:
            level, first = here, False
        if chg:
            level, start, data = here, None, []
        elif level is not None:
            if here <= level - 1:
                level, start, data = None, r, []
        elif here == start.values["l"]:
            data.append(r.token)
        elif here == start.values["l"] - 1:
            out.append((start.token, r.token, data))
            start, data = r, []
    return out


def day_changes(records):
    return [(b.token, a.day, b.day) for a, b in zip(records, records[1:]) if a.day != b.day]
