"""Row filters and projections over evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import labels, paths
from tracewright.functions.indicators import USN_REASONS

# Processes seen on ordinary fleets, endpoint agents included.
COMMON_PROCESSES = (
    "System", "Idle", "smss.exe", "csrss.exe", "winlogon.exe", "lsass.exe", "services.exe", "svchost.exe",
    "explorer.exe", "spoolsv.exe", "lsm.exe", "wininit.exe", "dllhost.exe", "conhost.exe", "wmiprvse.exe",
    "taskhost.exe", "taskhostw.exe", "RuntimeBroker.exe", "MsMpEng.exe", "msdtc.exe", "dwm.exe", "LogonUI.exe",
    "fontdrvhost.exe", "SearchUI.exe", "SearchIndexer.exe", "SearchProtocolHost.exe", "SearchFilterHost.exe",
    "ShellExperienceHost.exe", "sihost.exe", "ctfmon.exe", "audiodg.exe", "smartscreen.exe",
    "SecurityHealthService.exe", "SecurityHealthSystray.exe", "ApplicationFrameHost.exe",
    "backgroundTaskHost.exe", "TrustedInstaller.exe", "userinit.exe", "MemCompression", "SystemSettings.exe",
    "Registry", "Memory Compression", "rdpclip.exe", "tabtip.exe", "wermgr.exe", "wsqmcons.exe", "WUDFHost.exe",
    "ssh-agent.exe", "vmtoolsd.exe", "VGAuthService.exe", "vm3dservice.exe", "vmacthlp.exe", "masvc.exe",
    "macmnsvc.exe", "macompatsvc.exe", "ManagementAgent.exe", "ManagementAgentHost.exe", "mfemactl.exe",
    "mfemms.exe", "mfevtps.exe", "FireSvc.exe", "FireTray.exe", "ProtectedModuleHost.exe", "DLPAgent.exe",
    "DLPAgentService.exe", "HipMgmt.exe", "VsTskMgr.exe", "mcshield.exe", "mfeann.exe", "mfefire.exe",
    "mfehcs.exe", "mfetp.exe", "UpdaterUI.exe", "scriptproxy.exe", "shstat.exe", "naPrdMgr.exe",
    "FrameworkService.exe", "mctray.exe", "MSASCuiL.exe", "MpCmdRun.exe", "NisSrv.exe", "ccSvcHst.exe",
    "smcgui.exe", "smc.exe", "rtvscan.exe", "CarbonBlackClientSetup.exe", "csagent.exe", "CSFalconService.exe",
    "SentinelAgent.exe", "SentinelAgentWorker.exe", "SentinelHelperService.exe", "MSOSYNC.EXE",
    "OfficeClickToRun.exe", "OneDrive.exe",
)

# First non-empty path wins, per provider and envelope field.
CLOUD_PATHS = {
    "cloudtrail": {
        "timestamp": ("eventTime",),
        "actor": ("userIdentity.arn", "userIdentity.userName", "userIdentity.principalId"),
        "source_ip": ("sourceIPAddress",),
        "action": ("eventName",),
        "resource": ("eventSource",),
        "outcome": ("errorCode", "errorMessage"),
    },
    "entra_signin": {
        "timestamp": ("createdDateTime",),
        "actor": ("userPrincipalName", "userDisplayName"),
        "source_ip": ("ipAddress",),
        "action": ("appDisplayName", "clientAppUsed"),
        "resource": ("resourceDisplayName",),
        "outcome": ("status.errorCode", "status.failureReason"),
    },
    "entra_audit": {
        "timestamp": ("activityDateTime",),
        "actor": ("initiatedBy.user.userPrincipalName", "initiatedBy.app.displayName"),
        "source_ip": ("initiatedBy.user.ipAddress",),
        "action": ("activityDisplayName",),
        "resource": ("targetResources[0].displayName", "category"),
        "outcome": ("result",),
    },
    "m365_ual": {
        "timestamp": ("CreationTime", "CreationDate"),
        "actor": ("UserId", "UserKey"),
        "source_ip": ("ClientIP", "ClientIPAddress", "ActorIpAddress"),
        "action": ("Operation",),
        "resource": ("Workload", "ObjectId"),
        "outcome": ("ResultStatus",),
    },
    "gcp_audit": {
        "timestamp": ("timestamp",),
        "actor": ("protoPayload.authenticationInfo.principalEmail", "actor.email"),
        "source_ip": ("protoPayload.requestMetadata.callerIp",),
        "action": ("protoPayload.methodName", "events.name"),
        "resource": ("resource.type", "protoPayload.resourceName", "id.applicationName"),
        "outcome": ("severity",),
    },
    "k8s_audit": {
        "timestamp": ("requestReceivedTimestamp", "stageTimestamp"),
        "actor": ("user.username",),
        "source_ip": ("sourceIPs[0]",),
        "action": ("verb",),
        "resource": ("objectRef.resource", "requestURI"),
        "outcome": ("responseStatus.code", "responseStatus.reason"),
    },
    "vpc_flow": {
        "timestamp": ("start",),
        "actor": ("account_id",),
        "source_ip": ("srcaddr",),
        "action": ("action",),
        "resource": ("dstaddr",),
        "outcome": ("log_status",),
    },
}
CLOUD_PATHS["workspace"] = CLOUD_PATHS["gcp_audit"]

# Owners of writable-executable regions that are often benign, and a code prologue that never is.
SCANNER_OWNERS = ("msmpeng.exe", "mpcmdrun.exe", "nissrv.exe", "mcshield.exe", "ccsvchst.exe", "rtvscan.exe")
RUNTIME_OWNERS = ("w3wp.exe", "dotnet.exe", "iisexpress.exe", "java.exe", "javaw.exe", "node.exe", "sqlservr.exe")
CODE_PROLOGUES = ("^fce8[0-9a-f]{8}", "^e8000000005[0-9a-f]", "^fc4883e4f0e8")


def filter_ids(df: DataFrame, ids, column: str = "event_id") -> DataFrame:
    """Rows whose id is in the list; event ids and process ids alike."""
    return df.where(F.col(column).isin(list(ids)))


def between_or_null(col: Column, since: Column | None, until: Column | None) -> Column:
    """Inclusive range that rows without a value pass."""
    test = F.lit(True)
    if since is not None:
        test = test & (col >= since)
    if until is not None:
        test = test & (col <= until)
    return col.isNull() | test


def network_filter(df: DataFrame, ids=(3,), since=None, until=None, image=None, ip=None, port=None) -> DataFrame:
    """Conjunctive filter over network events; address and port are those of the destination."""
    out = filter_ids(df, ids).where(between_or_null(F.col("us"), since, until))
    if image is not None:
        out = out.where(F.contains(F.lower("image"), F.lit(image.lower())))
    if ip is not None:
        out = out.where(F.col("destination_ip") == ip)
    if port is not None:
        out = out.where(F.col("destination_port") == port)
    return out


def file_time_filter(df: DataFrame, since: Column | None, until: Column | None, column: str = "si_modified") -> DataFrame:
    return df.where(between_or_null(F.col(column), since, until))


def journal_filter(df: DataFrame, since=None, until=None, reasons=(), us: str = "us", mask: str = "reason_mask") -> DataFrame:
    """Journal rows in a time range with any of the reasons; an unknown reason name is an error."""
    unknown = [name for name in reasons if name.upper() not in USN_REASONS]
    if unknown:
        raise ValueError(f"unknown reason names: {unknown}")
    out = df
    if since is not None:
        out = out.where(F.col(us) >= since)
    if until is not None:
        out = out.where(F.col(us) <= until)
    if reasons:
        bits = sum({USN_REASONS[name.upper()] for name in reasons})
        out = out.where(F.col(mask).bitwiseAND(bits) != 0)
    return out


def min_level(df: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Alerts at or above a level; an unknown level name is an error."""
    if level.lower() not in labels.ALERT_LEVELS:
        raise ValueError(f"unknown level: {level}")
    return df.where(labels.level_rank(F.col(column)) >= labels.ALERT_LEVELS.index(level.lower()))


def project_first(df: DataFrame, raw: str, spec: dict) -> DataFrame:
    """Typed columns from a JSON text column: the first present spelling wins, other keys go to details."""
    rows = df.withColumn("__v", F.try_parse_json(F.col(raw)))
    picked = [
        F.coalesce(*[F.try_variant_get("__v", f"$['{key}']", "string") for key in keys]).alias(name)
        for name, keys in spec.items()
    ]
    used = [key for keys in spec.values() for key in keys]
    every = F.from_json(F.col(raw), "map<string,string>")
    details = F.map_filter(every, lambda k, v: ~k.isin(used)).alias("details")
    return rows.select(*df.columns, *picked, details)


def _cloud_text(raw: Column, path: str) -> Column:
    # Text and numbers count as values; objects, lists and booleans do not.
    value = F.try_variant_get(raw, "$." + path, "variant")
    scalar = F.schema_of_variant(value).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    text = F.try_variant_get(raw, "$." + path, "string")
    return F.when(scalar & (text != ""), text)


def cloud_envelope(df: DataFrame, provider: str, raw: str = "raw") -> DataFrame:
    """Six envelope columns from a provider's JSON record."""
    rows = df.withColumn("__v", F.try_parse_json(F.col(raw)))
    fields = CLOUD_PATHS.get(provider, {})
    out = []
    for name in ("timestamp", "actor", "source_ip", "action", "resource", "outcome"):
        found = [_cloud_text(F.col("__v"), path) for path in fields.get(name, ())]
        if name == "source_ip":
            found.append(_cloud_text(F.col("__v"), "sourceIPs[0]"))
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*df.columns, *out)


def event_data(df: DataFrame, raw: str = "raw", path: str = "$.Event.EventData.Data") -> DataFrame:
    """Name/value event data, list or plain object, as a string map column `fields`."""
    doc = F.try_parse_json(F.col(raw))
    listed = F.try_variant_get(doc, path, "array<variant>")
    named = F.filter(
        F.transform(listed, lambda e: F.struct(
            F.coalesce(F.try_variant_get(e, "$['@Name']", "string"), F.try_variant_get(e, "$.Name", "string"), F.try_variant_get(e, "$['#attributes'].Name", "string")).alias("k"),
            F.coalesce(F.try_variant_get(e, "$['#text']", "string"), F.try_variant_get(e, "$.Value", "string")).alias("v"),
        )),
        lambda p: p["k"].isNotNull(),
    )
    plain = F.try_variant_get(doc, path.rsplit(".", 1)[0], "map<string,string>")
    return df.withColumn("fields", F.coalesce(F.map_from_entries(named), plain))


def parse_stats(df: DataFrame, keys, parsed: Column, kept: Column) -> DataFrame:
    """Rows seen, kept and failed per key; all_failed marks sources where nothing parsed."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records_seen"),
        F.count_if(parsed & kept).alias("row_count"),
        F.count_if(~parsed).alias("parse_errors"),
        (F.count_if(parsed) == 0).alias("all_failed"),
    )


def is_uncommon(name: Column) -> Column:
    """Process name not on the common list, compared on the 14 characters kernel structures keep."""
    known = sorted({p.strip().lower()[:14] for p in COMMON_PROCESSES})
    return ~paths.image14(name).isin(known)


def region_hint(image: Column, mz: Column, sample_hex: Column) -> Column:
    """Benign guess for a writable-executable region; a header or code prologue rules it out."""
    low = F.lower(F.trim(image))
    never = F.coalesce(mz, F.lit(False)) | F.coalesce(F.lower(sample_hex).rlike("|".join(CODE_PROLOGUES)), F.lit(False))
    return (
        F.when(never, F.lit(None))
        .when(low.isin(*SCANNER_OWNERS), "possible_av_emulation")
        .when(low.isin(*RUNTIME_OWNERS), "possible_benign_jit_runtime")
    )


def cited(df: DataFrame, column: str = "tool_call_id") -> DataFrame:
    return df.where(F.coalesce(F.trim(column), F.lit("")) != "")
