"""The knowledge base: fixed values, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Action; sensitive fields; handler patterns; symbols; numeric ids.
ACTIONS = (
    ("UpdateFirmware", "location", "handle_update_firmware on_update_firmware process_update_firmware", "", ""),
    ("DataTransfer", "data", "handle_data_transfer on_data_transfer process_data_transfer", "", ""),
    ("SetChargingProfile", "chargingSchedule", "handle_set_charging_profile on_set_charging_profile process_set_charging_profile set_charging_profile", "MSG_SET_PROFILE ACTION_SET_CHARGING_PROFILE", "41"),
    ("RemoteStartTransaction", "idTag", "", "ACTION_REMOTE_START", "15"),
)
# Action, field; semantic type; sink domains; expected checks; CWEs; aliases.
FIELDS = (
    ("UpdateFirmware", "location", "firmware_download_url", "COMMAND_EXECUTION UNSAFE_FIRMWARE_DOWNLOAD", "URL_SCHEME_VALIDATION HOST_ALLOWLIST SIGNATURE_VERIFICATION SAFE_DOWNLOAD_API_NO_SHELL", "CWE-78 CWE-494 CWE-345 CWE-20", "location firmware_url firmwareLocation"),
    ("DataTransfer", "data", "vendor_controlled_payload", "database_query_execution", "DT_DATA_SCHEMA_VALIDATION DT_DATA_LENGTH_LIMIT SQL_PARAMETERIZATION", "CWE-89 CWE-20", "data"),
    ("SetChargingProfile", "csChargingProfiles.chargingSchedule", "charging_schedule_payload", "MEMORY_UNSAFE_OPERATION", "SCP_CHARGING_SCHEDULE_NOT_NULL SCP_PROFILE_LENGTH_BOUND", "CWE-120 CWE-787 CWE-20", "schedule"),
    ("SetChargingProfile", "csChargingProfiles.chargingSchedule.length", "profile_copy_length", "MEMORY_UNSAFE_OPERATION", "SCP_PROFILE_LENGTH_BOUND", "CWE-120 CWE-787 CWE-20", "schedule_length chargingScheduleLength"),
    ("RemoteStartTransaction", "idTag", "remote_authorization_id", "COMMAND_EXECUTION", "RS_IDTAG_INPUT_VALIDATION RS_NO_SHELL_EXECUTION", "CWE-78 CWE-20", "idTag"),
)
# Check; type; domains that disprove it; CWEs.
CHECKS = (
    ("URL_SCHEME_VALIDATION", "INPUT_VALIDATION", "", "CWE-20"),
    ("HOST_ALLOWLIST", "POLICY_VALIDATION", "", "CWE-20"),
    ("SIGNATURE_VERIFICATION", "INTEGRITY_VERIFICATION", "", "CWE-345 CWE-494"),
    ("SAFE_DOWNLOAD_API_NO_SHELL", "SAFE_API_USAGE", "COMMAND_EXECUTION", "CWE-78"),
    ("DT_DATA_SCHEMA_VALIDATION", "INPUT_VALIDATION", "", "CWE-20"),
    ("DT_DATA_LENGTH_LIMIT", "INPUT_VALIDATION", "", "CWE-20 CWE-1284"),
    ("SQL_PARAMETERIZATION", "SAFE_API_USAGE", "database_query_execution", "CWE-89"),
    ("SCP_CHARGING_SCHEDULE_NOT_NULL", "INPUT_VALIDATION", "", "CWE-476 CWE-20"),
    ("SCP_PROFILE_LENGTH_BOUND", "INPUT_VALIDATION", "", "CWE-120 CWE-787 CWE-20"),
    ("RS_IDTAG_INPUT_VALIDATION", "INPUT_VALIDATION", "", "CWE-20"),
    ("RS_NO_SHELL_EXECUTION", "SAFE_API_USAGE", "COMMAND_EXECUTION", "CWE-78"),
)
# Domain; severity; CWEs; apis.
SINKS = (
    ("COMMAND_EXECUTION", "HIGH", "CWE-78", "system popen execl execlp execle execv execvp execvpe"),
    ("MEMORY_UNSAFE_OPERATION", "MEDIUM_HIGH", "CWE-120 CWE-787", "strcpy strcat sprintf gets memcpy vsprintf"),
    ("FILE_WRITE", "MEDIUM", "CWE-22", "fopen open fwrite write"),
    ("database_query_execution", "HIGH", "CWE-89", "sqlite3_exec mysql_query pqexec"),
)
# Root cause; missing checks; domains.
ROOT_CAUSES = (
    ("untrusted_ocpp_field_to_dangerous_sink", "URL_SCHEME_VALIDATION HOST_ALLOWLIST SAFE_DOWNLOAD_API_NO_SHELL", "COMMAND_EXECUTION UNSAFE_FIRMWARE_DOWNLOAD"),
    ("missing_firmware_integrity_verification", "SIGNATURE_VERIFICATION", "UNSAFE_FIRMWARE_DOWNLOAD FIRMWARE_INSTALL"),
    ("untrusted_payload_to_sql_injection", "SQL_PARAMETERIZATION DT_DATA_SCHEMA_VALIDATION", "database_query_execution"),
    ("remote_length_to_unbounded_profile_copy", "SCP_PROFILE_LENGTH_BOUND SCP_CHARGING_SCHEDULE_NOT_NULL", "MEMORY_UNSAFE_OPERATION"),
    ("remote_id_to_command_injection", "RS_IDTAG_INPUT_VALIDATION RS_NO_SHELL_EXECUTION", "COMMAND_EXECUTION"),
)
# Fixed values, by priority: check type; strength; expected check; call names; operators; operand names;
# literal prefixes; operators that suffice.
CHECK_PATTERNS = (
    ("NULL_CHECK", "WEAK", None, "", "equals notEquals", "NULL nullptr", "", "logicalNot"),
    ("URL_SCHEME_CHECK", "STRONG", "URL_SCHEME_VALIDATION", "strncmp strncasecmp startswith starts_with validateurlscheme isallowedscheme", "equals notEquals", "", "http", ""),
    ("HOST_ALLOWLIST_CHECK", "STRONG", "HOST_ALLOWLIST", "isallowedhost in_allowlist host_allowed check_host", "", "", "", ""),
    ("SIGNATURE_VERIFICATION", "STRONG", "SIGNATURE_VERIFICATION", "verify_signature verifysignature check_signature pgp_verify rsa_verify", "", "", "", ""),
    ("LENGTH_CHECK", "WEAK", None, "strlen strnlen", "", "", "", ""),
    ("AUTHORIZATION_CHECK", "STRONG", "OPERATOR_PERMISSION_CHECK", "is_authorized check_permission has_permission authorize", "", "", "", ""),
    ("SCHEMA_VALIDATION", "STRONG", "DT_DATA_SCHEMA_VALIDATION", "json_schema_validate validate_data_transfer_payload", "", "", "", ""),
    ("LENGTH_LIMIT", "STRONG", "DT_DATA_LENGTH_LIMIT", "strlen_bound bounded_parser max_length_check strnlen", "", "", "", ""),
    ("SQL_PARAMETERIZATION", "STRONG", "SQL_PARAMETERIZATION", "sqlite3_prepare_v2 sqlite3_bind_text parameterized_query", "", "", "", ""),
    ("LENGTH_BOUND_CHECK", "STRONG", "SCP_PROFILE_LENGTH_BOUND", "", "lessThan lessEqualsThan greaterThan greaterEqualsThan", "", "", ""),
)
# Calls that write without a bound, and with one.
UNBOUNDED_SINKS = "gets strcpy strcat sprintf vsprintf _getws getwd wcscpy wcscat lstrcpy lstrcat stpcpy wcpcpy _mbscpy _mbscat wsprintf wvsprintf".split()
BOUNDED_SINKS = "memcpy memmove strncpy snprintf vsnprintf fgets read recv getline".split()
# Semantic category of a call, by lower-cased name; an earlier category wins.
CALL_CATEGORIES = {
    1: "malloc calloc realloc xmalloc xcalloc xrealloc valloc memalign heapalloc heaprealloc heapcreate new new[] alloca _alloca",
    2: "memcpy memmove memcpy_s memmove_s bcopy copymemory rtlcopymemory wmemcpy wmemmove wmemcpy_s wmemmove_s strcpy strcpy_s strncpy strncpy_s wcscpy wcscpy_s wcsncpy wcsncpy_s lstrcpy lstrcpyn strcpyn strcpynw strcat strcat_s strncat strncat_s wcscat wcscat_s wcsncat wcsncat_s lstrcat strcatn strcatnw",
    3: "gets gets_s fgets getline scanf sscanf fscanf scanf_s sscanf_s fscanf_s wscanf swscanf fwscanf wscanf_s swscanf_s fwscanf_s read pread pread64 fread recv recvfrom",
    4: "printf fprintf vprintf vfprintf puts printintline sprintf vsprintf snprintf vsnprintf sprintf_s vsprintf_s _snprintf _vsnprintf _snwprintf _vsntprintf swprintf vswprintf vswprintf_s wsprintf wvsprintf wnsprintf wvnsprintf",
    5: "memset bzero wmemset rtlzeromemory",
    6: "connect",
    7: "closesocket close close_socket",
    8: "socket wsasocket",
    9: "atoi atol atoll _atoi64",
    10: "strtol strtoul strtoll strtoull strtoimax strtoumax wcstol wcstoul wcstoll wcstoull wcstoimax wcstoumax",
}
LIFTABLE_CATEGORIES = (1, 2, 3, 5, 6, 7, 8)
# Positions of the target and the size among a call's arguments; -1 for none.
API_SLOTS = {"memcpy": (0, 2), "memmove": (0, 2), "memset": (0, 2), "strncpy": (0, 2), "strncat": (0, 2), "snprintf": (0, 1), "vsnprintf": (0, 1), "fgets": (0, 1), "read": (1, 2), "recv": (1, 2), "strcpy": (0, -1), "strcat": (0, -1), "sprintf": (0, -1), "vsprintf": (0, -1), "gets": (0, -1)}

CALL_CATEGORY = {}
for _id, _names in CALL_CATEGORIES.items():
    for _name in _names.split():
        CALL_CATEGORY.setdefault(_name, _id)


class KnowledgeBase:
    """The tables above as DataFrames; every argument replaces one of them."""

    def __init__(self, spark: SparkSession, actions=ACTIONS, fields=FIELDS, checks=CHECKS, sinks=SINKS, causes=ROOT_CAUSES, patterns=CHECK_PATTERNS) -> None:
        self.spark = spark
        words = str.split
        self.actions = self._table([(i, a, words(f), words(h), words(s), [int(n) for n in words(k)]) for i, (a, f, h, s, k) in enumerate(actions)], "ord int, action string, fields array<string>, handlers array<string>, symbols array<string>, numeric array<int>")
        self.fields = self._table([(i, a, f, t, words(d), words(c), words(w), words(x)) for i, (a, f, t, d, c, w, x) in enumerate(fields)], "ord int, action string, field string, semantic string, domains array<string>, checks array<string>, cwes array<string>, aliases array<string>")
        self.checks = self._table([(i, c, t, words(n), words(w)) for i, (c, t, n, w) in enumerate(checks)], "ord int, check string, check_type string, negative_domains array<string>, cwes array<string>")
        self.apis = self._table([(i, d, s, w, a) for i, (d, s, w, names) in enumerate(sinks) for a in words(names)], "ord int, domain string, severity string, cwe string, api string")
        self.causes = self._table([(i, c, words(m), words(d)) for i, (c, m, d) in enumerate(causes)], "ord int, id string, checks array<string>, domains array<string>")
        op = lambda s: [f"<operator>.{x}" for x in words(s)]
        self.patterns = self._table([(i, t, s, e, words(c), op(o), words(n), words(p), op(alone)) for i, (t, s, e, c, o, n, p, alone) in enumerate(patterns)], "priority int, check_type string, strength string, expected string, call_names array<string>, operators array<string>, operand_identifiers array<string>, literal_prefixes array<string>, standalone array<string>")

    def _table(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def reverse(self) -> DataFrame:
        """by, key, action: actions by symbol, number and name."""
        each = lambda by, c: self.actions.select(F.lit(by).alias("by"), F.explode(c.cast("array<string>")).alias("key"), "action")
        return each("symbol", F.col("symbols")).unionByName(each("numeric", F.col("numeric"))).unionByName(each("name", F.array(F.upper("action"))))

    def slots(self) -> DataFrame:
        return self._table([(n, d, s) for n, (d, s) in API_SLOTS.items()], "name string, dst int, size int")
