"""Made-up phone logs for tests: records, their text, and the order a boot is read in."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

DEVICE = "a" * 40
BOOT = "00000000-0000-4000-8000-000000000001"


@dataclass(frozen=True)
class Record:
    token: int
    trace_us: int
    kind: str
    values: dict = field(default_factory=dict, hash=False)
    boot: str = BOOT
    device: str = DEVICE
    day: int = 1


def seconds(us: int) -> str:
    return f"{us // 1_000_000}.{us % 1_000_000:06d}"


def payload(kind: str, v: dict, us: int) -> tuple[str, str]:
    """Tag and payload of a record."""
    trace = {
        "freq": "cpu_frequency: state={freq} cpu_id={cpu}",
        "hotplug": "sched_cpu_hotplug: cpu {cpu} {word} error={error}",
        "temp": "thermal_temp: sensor_id={sensor} temp={temp}",
        "ncpu": "phonelab_num_online_cpus: num_online_cpus={n}",
        "fg": "phonelab_proc_foreground: pid={pid} tgid={pid} comm=app",
        "marker": "phonelab_periodic_ctx_switch_marker: {marker} cpu={cpu} count=3 log_idx=5",
        "info": "phonelab_periodic_ctx_switch_info: cpu={cpu} pid=1 tgid=1 nice=0 comm={comm} utime=0 stime=0"
        " rtime={rtime} bg_utime=0 bg_stime=0 bg_rtime={bg} s_run=0 s_int=0 s_unint=0 s_oth=0 log_idx=1",
        "noise": "other_tag: x={x}",
    }
    printk = {
        "health": "healthd: battery l={l} v=4000 t=30.5 h=2 st=3 c=-100 chg={chg}",
        "power": "PM: suspend {power} 2017-05-06 07:08:09.101112131 UTC",
    }
    if kind in trace:
        return "Kernel-Trace", f"kworker/0:1-1 [000] ...1 {seconds(us)}: " + trace[kind].format(**v)
    return "KernelPrintk", f"<6>[{seconds(us)}] " + printk[kind].format(**v)


def device_line(token, trace_us, tag, text, boot=BOOT, device=DEVICE, day=1) -> str:
    stamp = f"2016-01-{day:02d} 10:00:00.123456"
    return f"{device}\t1461715200524   1461715200524.17  {boot}  {token} {seconds(trace_us)}  {stamp} 203  204  D  {tag}   {text}"


def line_of(r: Record) -> str:
    tag, text = payload(r.kind, r.values, r.trace_us)
    return device_line(r.token, r.trace_us, tag, text, r.boot, r.device, r.day)


def random_boot(seed: int, rows: int, boot: str = BOOT, ties: bool = False) -> list[Record]:
    """Records of one boot in order; ``ties`` lets tokens repeat and copies lines."""
    rng = random.Random(seed)
    records, token, us, day, level = [], 0, 5_000_000, 1, 90
    while len(records) < rows:
        token += 0 if ties and rng.random() < 0.15 else rng.choice([1, 1, 1, 2, 5])
        us += rng.choice([1_000, 300_000, 400_000, 1_000_000, 1_700_000])
        day += rng.random() < 0.05
        cpu = rng.randrange(4)
        kind = rng.choice(["freq", "freq", "hotplug", "temp", "ncpu", "fg", "marker", "info", "noise", "health", "health", "power"])
        if rng.random() < 0.4:
            level += rng.choice([-1, -1, -1, 1])
        values = {
            "freq": {"freq": rng.choice([0, 300000, 600000, 1200000]), "cpu": cpu},
            "hotplug": {"cpu": cpu, "word": rng.choice(["online", "offline", "offline", "frozen"]), "error": rng.choice([0, 0, 0, -1])},
            "temp": {"sensor": cpu, "temp": rng.randrange(30, 40)},
            "ncpu": {"n": rng.randrange(1, 5)},
            "fg": {"pid": rng.choice([0, 0, 17, 18])},
            "marker": {"marker": rng.choice(["BEGIN", "END"]), "cpu": cpu % 2},
            "info": {"cpu": cpu % 2, "comm": rng.choice(["swapper/0", "a b"]), "rtime": rng.randrange(3), "bg": rng.randrange(2)},
            "noise": {"x": rng.randrange(3)},
            "health": {"l": max(level, 0), "chg": "u" if rng.random() < 0.08 else ""},
            "power": {"power": rng.choice(["entry", "exit"])},
        }[kind]
        record = Record(token, us, kind, values, boot, day=min(day, 28))
        records.extend([record] * (3 if ties and rng.random() < 0.05 else 1))
    return records
