"""Names, label maps and published scores that results must agree with."""

NSL_KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "label", "difficulty",
]
NSL_KDD_TEXT_COLUMNS = ["protocol_type", "service", "flag"]
NSL_KDD_LONG_COLUMNS = ["duration", "src_bytes", "dst_bytes"]

# Label (lower case) -> category, per category.
NSL_KDD_CATEGORIES = {
    "Normal": ["normal"],
    "DoS": [
        "back", "land", "neptune", "pod", "smurf", "teardrop", "apache2", "udpstorm",
        "processtable", "mailbomb", "worm",
    ],
    "Probe": ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"],
    "R2L": [
        "guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient",
        "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack", "httptunnel", "sendmail", "named",
    ],
    "U2R": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps"],
}
# Two labels sit elsewhere in the general-purpose map.
GENERAL_OVERRIDES = {"worm": "R2L", "httptunnel": "U2R"}

CICIDS_CATEGORIES = {
    "Benign": ["BENIGN"],
    "Brute Force": ["FTP-Patator", "SSH-Patator"],
    "DoS": ["DoS slowloris", "DoS Slowhttptest", "DoS Hulk", "DoS GoldenEye"],
    "Heartbleed": ["Heartbleed"],
    "Web Attack": [
        "Web Attack – Brute Force", "Web Attack – XSS", "Web Attack – Sql Injection",
    ],
    "Infiltration": ["Infiltration"],
    "Botnet": ["Bot"],
    "PortScan": ["PortScan"],
    "DDoS": ["DDoS"],
}
WSN_CATEGORIES = {
    "Normal": ["Normal"],
    "Flooding": ["Flooding"],
    "Blackhole": ["Blackhole"],
    "Grayhole": ["Grayhole"],
    "TDMA": ["TDMA", "Scheduling"],
}
CYBER_CATEGORIES = {
    "DDoS": ["DDoS"],
    "Malware": ["Malware"],
    "Intrusion": ["Intrusion"],
    "Normal": ["Normal", "Benign"],
}

CICIDS_LABEL_NAMES = ["Label", "label", " Label", "LABEL"]
CICIDS_NOT_FEATURES = [
    "Label", "label", " Label", "_Label", "attack_category", "Flow_ID", "Flow ID", "Source_IP",
    "Source IP", "Destination_IP", "Destination IP", "Src_IP", "Dst_IP", "Timestamp",
    "Source_Port", "Source Port", "Destination_Port", "Destination Port", "Src_Port", "Dst_Port",
]
WSN_RENAMES = {
    "who CH": "who_CH",
    "Attack type": "Attack_type",
    "Expaned Energy": "Expaned_Energy",
}
WSN_NOT_FEATURES = ["id", "Attack_type", "attack_category", "target"]
WSN_FEATURES = {
    "Time": "long", "Is_CH": "int", "who_CH": "long", "Dist_To_CH": "double", "ADV_S": "int",
    "ADV_R": "int", "JOIN_S": "int", "JOIN_R": "int", "SCH_S": "int", "SCH_R": "int",
    "Rank": "int", "DATA_S": "int", "DATA_R": "int", "Data_Sent_To_BS": "int",
    "dist_CH_To_BS": "double", "send_code": "int", "Expaned_Energy": "double",
}
CYBER_NUMERIC = ["Source Port", "Destination Port", "Packet Length", "Anomaly Scores"]
CYBER_CATEGORICAL = [
    "Protocol", "Packet Type", "Traffic Type", "Action Taken", "Severity Level",
    "Network Segment", "Malware Indicators", "Alerts/Warnings", "Attack Signature", "Log Source",
    "IDS/IPS Alerts",
]

# Best published F1 per dataset, and the value assumed for any other dataset.
PUBLISHED_BEST = {"CICIDS2017": ("Extra Trees", 0.9980), "NSL-KDD": ("Extra Trees", 0.9950)}
PUBLISHED_DEFAULT = ("Unknown", 0.99)

# Declared search spaces, by the parameter names the models here use.
SEARCH_SPACES = {
    "random_forest": {
        "numTrees": [100, 200, 300],
        "maxDepth": [10, 20, 30],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2"],
    },
    "boosted_trees": {
        "maxIter": [100, 200, 300],
        "maxDepth": [3, 5, 7, 9],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    },
    "linear_svm": {"regParam": [10.0, 1.0, 0.1, 0.01]},
}

# Declared search spaces of six kinds of models, by the names that the builders of models/search.py take. A depth without a limit is the largest one
# given here; settings that the models here do not have (rows needed to split, leaves, absolute penalties, other kernels) are left out.
SETTING_SPACES = {
    "random_forest": {
        "trees": [100, 200, 300],
        "depth": [10, 20, 30],
        "least": [1, 2, 4],
        "features": ["sqrt", "log2"],
        "weights": ["balanced", None],
    },
    "boosted_trees": {
        "rounds": [100, 200, 300],
        "depth": [3, 5, 7, 9],
        "rate": [0.01, 0.05, 0.1],
        "rows": [0.7, 0.8, 0.9, 1.0],
        "columns": [0.7, 0.8, 0.9, 1.0],
        "l2": [0.0, 0.1, 1.0],
    },
    "boosted_leaves": {
        "rounds": [100, 200, 300],
        "depth": [5, 7, 10],
        "rate": [0.01, 0.05, 0.1],
        "rows": [0.7, 0.8, 0.9, 1.0],
        "columns": [0.7, 0.8, 0.9, 1.0],
    },
    "symmetric_trees": {
        "rounds": [100, 200, 300],
        "depth": [4, 6, 8, 10],
        "rate": [0.01, 0.05, 0.1],
        "l2": [1.0, 3.0, 5.0, 7.0],
    },
    "gradient_boosting": {
        "rounds": [50, 100, 200, 300],
        "rate": [0.01, 0.05, 0.1, 0.2],
        "depth": [3, 5, 7, 10],
        "rows": [0.6, 0.8, 1.0],
    },
    "kernel_svm": {
        "penalty": [10.0, 1.0, 0.1, 0.01],
        "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0],
    },
}


def label_to_category(categories: dict[str, list[str]]) -> dict[str, str]:
    return {label: category for category, labels in categories.items() for label in labels}
