"""Fixed values of the log format.

Everything in this module is given by the producers of the logs (Android's
logcat, the kernel's printk and trace rings, and the on-device logger), not by
this library.  Patterns are Java regular expressions with numbered groups.
"""

# The two layouts of a log line.
# The device is a whole word: a search from within it could only find what one from its start finds.
# Groups: device, boot, token, trace seconds, date and time, pid, tid, level, tag, payload.
DEVICE_LAYOUT = (
    r"(?<![a-z0-9])([a-z0-9]+)\s+\d+\s+\d+(?:\.\d+)?\s+([a-z0-9\-]{36})\s+(\d+)\s+(\d+\.\d+)"
    r"\s+(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\d+)\s+([A-Z]+)\s+(\S+)\s+(.*)"
)
# Groups: boot, date and time, token, trace seconds, pid, tid, level, tag, payload.
LOGCAT_LAYOUT = (
    r"([a-z0-9\-]{36})\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s*(\d+)"
    r"\s*\[\s*(\d+\.\d+)\]\s*(?>(\d+)\s*(\d+))\s*([A-Z]+)\s*(\S+?)\s*:\s*(.*)"
)

# Tags of the two kernel sources inside logcat.
TRACE_SOURCE = "Kernel-Trace"
PRINTK_SOURCE = "KernelPrintk"

# Fixed value: kernel trace header.
# Groups: thread, cpu, flags, timestamp, trace tag, text.
# A search begins at a line's start, and blanks are read once, so that text without a header is passed over quickly.
TRACE_HEADER = r"(?<![^\n])(?:\s*+|(?=\s+\[))(.*?)(?<!\s)\s++\[(\d+)\]\s+(.{4})\s+(\d+\.\d+): (.*?):\s+(.*)"

# Trace tags with a typed payload.
HOTPLUG = "sched_cpu_hotplug"
THERMAL = "thermal_temp"
CPU_FREQUENCY = "cpu_frequency"
ONLINE_CPUS = "phonelab_num_online_cpus"
FOREGROUND = "phonelab_proc_foreground"
CTX_MARKER = "phonelab_periodic_ctx_switch_marker"
CTX_INFO = "phonelab_periodic_ctx_switch_info"

# Payload text of each trace tag.
HOTPLUG_TEXT = r"\s*cpu\s+(\d+)\s+([a-zA-Z0-9_]+)\s+error=(-?\d+)"
THERMAL_TEXT = r"\s*sensor_id=(\d+)\s+temp=(\d+)"
CPU_FREQUENCY_TEXT = r"\s*state=(\d+)\s+cpu_id=(\d+)"
ONLINE_CPUS_TEXT = r"\s*num_online_cpus=(\d+)"
FOREGROUND_TEXT = r"\s*pid=(\d+) tgid=(\d+) comm=(\S+)"
CTX_MARKER_TEXT = r"\s*(BEGIN|END)\s+cpu=(\d+)\s+count=(\d+)\s+log_idx=(\d+)"
CTX_INFO_TEXT = (
    r"\s*cpu=(\d+)\s*pid=(\d+)\s*tgid=(\d+)\s*nice=(-?\d+)\s*comm=(.*?)\s*utime=(\d+)"
    r"\s*stime=(\d+)\s*rtime=(\d+)\s*bg_utime=(\d+)\s*bg_stime=(\d+)\s*bg_rtime=(\d+)"
    r"\s*s_run=(\d+)\s*s_int=(\d+)\s*s_unint=(\d+)\s*s_oth=(\d+)\s*log_idx=(\d+)"
    r"(?:\s*rx=(\d+)\s*tx=(\d+))?"
)

# Printk payloads.  The first group of the last two is the timestamp.
MSM_THERMAL_TEXT = (
    r"(?:<\d+>)?\s*\[\s*\d+\.\d+\]\s*msm_thermal: (Set Offline:|Allow Online) CPU(\d+) Temp: (\d+)"
)
POWER_TEXT = (
    r"(?:<\d+>)?\s*\[\s*\d+\.\d+\]\s*PM: suspend (entry|exit)"
    r" (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d+) \S+"
)
HEALTHD_TEXT = (
    r"(?:<\d+>)?\s*\[\s*(\d+\.\d+)\]\s*healthd:\s*battery\s*l=(\d+)\s+v=(\d+)\s+t=(\d+\.\d+)"
    r"\s+h=(-?\d+)\s+st=(-?\d+)\s+c=(-?\d+)\s+chg=((?:[auw]+)?)"
)
PVS_TEXT = (
    r"(?:<\d+>)?\s*\[\s*(\d+\.\d+)\]\s*acpuclk-8974 qcom,acpuclk\.30: ACPU PVS: (\d+)"
)

# Words looked for in whole lines or payloads.
PVS_WORD = "ACPU PVS:"
SUSPEND_ENTRY_WORD = "PM: suspend entry"
SUSPEND_EXIT_WORD = "PM: suspend exit"
SUSPEND_DONE_WORD = "PM: suspend of devices complete"
IDLE_TASK_WORD = "swapper"

# Fixed value: a device directory is named by 40 hex digits.
DEVICE_DIR = r"(?:^|[/=])([a-f0-9]{40})(?:/|$)"
