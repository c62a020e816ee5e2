"""Log-like inputs derived from the ``events`` table.

The tables at hand have no addresses, ports, gaps or raw attack labels, so these
are computed from ``events`` by arithmetic. The expressions are plain SQL text
that Spark and other engines read alike; they are inputs, not operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch import fixed_values as fixed
from tidewatch.plans.registry import table

_A = "case event_id % 5 when 0 then 10 when 1 then 192 when 2 then 172 else (event_id * 7 + user_id) % 256 end"
_B = "case when event_id % 5 = 1 then 168 else (event_id * 13) % 256 end"
_C = "case when event_id % 3 = 0 then 10 else (event_id * 11) % 256 end"


def _dotted(*parts: str) -> str:
    return " || '.' || ".join(f"cast({p} as string)" for p in parts)


FLOWS = {
    "flow_id": "event_id",
    "ts": "case when event_id % 29 = 0 then null else ts end",
    "src_ip": "case when event_id % 31 = 0 then null when event_id % 37 = 0 then 'bad-ip' "
              f"else {_dotted(_A, _B, 'user_id % 8', 'event_id % 256')} end",
    "dst_ip": _dotted(_C, "(event_id * 13) % 256", "user_id % 8", "(event_id * 3) % 256"),
    "src_port": "(event_id * 7919) % 65536",
    "dst_port": "(user_id * 104729 + event_id) % 65536",
    "anomaly_score": "case when event_id % 17 = 0 then null when event_id % 101 = 0 "
                     "then cast('inf' as double) else value end",
    "protocol": "case when event_id % 23 = 0 then null when event_id % 2 = 0 then 'TCP ' else 'UDP' end",
    "payload": "case when event_id % 19 = 0 then null else props end",
    "device_info": "case event_id % 4 when 0 then 'Mozilla/5.0 (Android) Chrome/120' "
                   "when 1 then 'MOZILLA Firefox/99' when 2 then 'Trident/7.0' else '' end",
    "raw_label": "case event_type when 'click' then ' BENIGN ' when 'view' then 'normal' "
                 "when 'error' then 'DoS' when 'signup' then 'Probe' else 'unlisted' end",
}

# Class of an event by alphabetical code, and three sets of class scores that
# favour the true class more and more.
CLASSES = ["click", "error", "purchase", "signup", "view"]
MODELS = {"weak": 20, "medium": 45, "strong": 70}
_Y = "case event_type " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(CLASSES)) + " end"


def _weight(m: int, c: int, boost: int) -> str:
    return (
        f"((event_id * {7 + 2 * c + m} + user_id * {c + 1 + m}) % 97 + 1 "
        f"+ case when event_type = '{CLASSES[c]}' then {boost} else 0 end)"
    )


def _score_columns(m: int, boost: int) -> dict[str, str]:
    w = [_weight(m, c, boost) for c in range(len(CLASSES))]
    total = "cast(" + " + ".join(w) + " as double)"
    best = "greatest(" + ", ".join(w) + ")"
    first = "case " + " ".join(f"when {x} = {best} then {c}" for c, x in enumerate(w)) + " end"
    return {
        "event_id": "event_id", "y": _Y, "pred": first,
        **{f"p{c}": f"{x} / {total}" for c, x in enumerate(w)},
        "binary_score": f"({' + '.join(w[1:])}) / {total}",  # any class but the first
    }


SCORES = {name: _score_columns(m, boost) for m, (name, boost) in enumerate(MODELS.items())}

_SIGNAL = "case event_type when 'click' then 0 when 'view' then 1 when 'error' then 5 when 'signup' then 9 else 14 end"


def _nsl_value(i: int, name: str) -> str:
    if name == "protocol_type":
        return "case event_id % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end"
    if name == "service":
        return "case event_id % 5 when 0 then 'http' when 1 then 'ftp' when 2 then 'smtp' when 3 then 'dns' else 'ssh' end"
    if name == "flag":
        return "case user_id % 3 when 0 then 'SF' when 1 then 'S0' else 'REJ' end"
    if name == "label":
        return ("case event_type when 'click' then 'normal' when 'view' then ' Normal ' when 'error' then 'NEPTUNE' "
                "when 'signup' then 'satan' else case when event_id % 2 = 0 then 'guess_passwd' else 'mystery' end end")
    if name == "difficulty":
        return "event_id % 22"
    if name.endswith("_rate"):
        return f"((event_id * {i + 1} + {_SIGNAL}) % 101) / 1e2"
    return f"(event_id * {i + 3} + user_id) % {10 + i} + {_SIGNAL}"


NSL_KDD = {name: _nsl_value(i, name) for i, name in enumerate(fixed.NSL_KDD_COLUMNS)}

WSN = {"id": "event_id"} | {
    name: (f"((event_id * {i + 2}) % 1009) / 1e1 + {_SIGNAL}" if kind == "double"
           else f"(event_id * {i + 5} + user_id) % {7 + i} + {_SIGNAL}")
    for i, (name, kind) in enumerate(fixed.WSN_FEATURES.items())
} | {
    "Attack_type": "case event_type when 'click' then 'Normal' when 'view' then ' Normal' when 'error' then 'Flooding' "
                   "when 'signup' then 'Scheduling' else case when event_id % 3 = 0 then 'Blackhole' else 'Grayhole ' end end",
}
# Header names as the sensor log spells them.
WSN_HEADER = {"who_CH": "who CH", "Attack_type": " Attack type", "Expaned_Energy": "Expaned Energy"}

CICIDS = {
    "Flow_ID": "cast(event_id as string)",
    "Source_IP": FLOWS["dst_ip"],
    "Destination_Port": "(user_id * 104729 + event_id) % 65536",
    "Flow_Duration": f"(event_id * 7919) % 100003 + 1000 * ({_SIGNAL})",
    "Total_Fwd_Packets": f"(event_id * 31 + user_id) % 97 + ({_SIGNAL})",
    "Flow_Bytes_s": "case when event_id % 17 = 0 then null when event_id % 101 = 0 then cast('inf' as double) else value end",
    "Flow_Packets_s": f"case when event_id % 53 = 0 then cast('nan' as double) else ((event_id * 13) % 997) / 1e1 + ({_SIGNAL}) end",
    "Bwd_PSH_Flags": "0",
    "Label": "case event_type when 'click' then 'BENIGN' when 'view' then ' BENIGN' when 'error' then 'DoS Hulk' "
             "when 'signup' then 'PortScan' else case when event_id % 2 = 0 then 'Bot' else 'Unheard Of' end end",
}
CICIDS_HEADER = {
    "Flow_ID": "Flow ID", "Source_IP": " Source IP", "Destination_Port": " Destination Port",
    "Flow_Duration": " Flow Duration", "Total_Fwd_Packets": " Total Fwd Packets", "Flow_Bytes_s": "Flow Bytes/s",
    "Flow_Packets_s": " Flow Packets/s", "Bwd_PSH_Flags": " Bwd PSH Flags", "Label": " Label",
}


def _pick(*values: str, by: str = "event_id") -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case {by} % {len(values)} {cases} else '{values[-1]}' end"


CYBER = {
    "Row": "event_id",
    "Timestamp": "case when event_id % 29 = 0 then 'not a time' else strftime(ts, '%Y-%m-%d %H:%M:%S') end",
    "Source IP Address": FLOWS["src_ip"],
    "Destination IP Address": FLOWS["dst_ip"],
    "Source Port": "case when event_id % 43 = 0 then 'n/a' else cast((event_id * 7919) % 65536 as string) end",
    "Destination Port": "cast((user_id * 104729 + event_id) % 65536 as string)",
    "Packet Length": f"cast((event_id * 17) % 1500 + 20 * ({_SIGNAL}) as string)",
    "Anomaly Scores": f"case when event_id % 17 = 0 then null else cast((event_id * 37) % 1000 / 1e1 + 10 * ({_SIGNAL}) as string) end",
    "Protocol": "case when event_id % 23 = 0 then null when event_id % 2 = 0 then 'TCP' else ' UDP' end",
    "Packet Type": _pick("Data", "Control"),
    "Traffic Type": _pick("HTTP", "DNS", "FTP"),
    "Action Taken": _pick("Blocked", "Logged", "Ignored", by="user_id"),
    "Severity Level": _pick("Low", "Medium", "High", by="(event_id + user_id)"),
    "Payload Data": "case when event_id % 19 = 0 then null else props || ' \"quoted, text\"' end",
    "Device Information": FLOWS["device_info"],
    "Firewall Logs": "case when event_id % 2 = 0 then 'Log Data' else null end",
    "Attack Type": "case event_type when 'click' then 'DDoS' when 'view' then ' Malware' when 'error' then 'Intrusion' "
                   "when 'signup' then 'Benign' else 'Other' end",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f'{expression} as "{name}"' for name, expression in columns.items())


def from_events(columns: dict[str, str]) -> str:
    """The derived table as SQL text."""
    return f"select {select_list(columns)} from events"


def spark_from_events(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    spelled = [
        f"{e.replace('strftime(ts, ', 'date_format(ts, ').replace('%Y-%m-%d %H:%M:%S', 'yyyy-MM-dd HH:mm:ss')} as `{name}`"
        for name, e in columns.items()
    ]
    return table(spark, folder, "events").selectExpr(*spelled)


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return spark_from_events(spark, folder, FLOWS)


FLOWS_SQL = from_events(FLOWS)


def scores(spark: SparkSession, folder: str, model: str = "medium") -> DataFrame:
    return spark_from_events(spark, folder, SCORES[model])


def scores_sql(model: str = "medium") -> str:
    return from_events(SCORES[model])


def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the three score sets, one row per (model, event)."""
    parts = [spark_from_events(spark, folder, {"model": f"'{m}'"} | SCORES[m]) for m in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ALL_SCORES_SQL = " union all ".join(from_events({"model": f"'{m}'"} | SCORES[m]) for m in MODELS)
