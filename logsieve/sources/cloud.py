"""Cloud audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.clock import normalize_timestamp
from logsieve.functions.net import lookup
from logsieve.sources.jsonlogs import ENVELOPES, objects
from logsieve.sources.jsonsplit import read_json_records

# fixed values: calls of high risk and what they do
HIGH_RISK_CALLS = {
    "CreateAccessKey": "Credential creation", "CreateUser": "User creation", "AttachUserPolicy": "Policy attachment",
    "PutUserPolicy": "Inline policy creation", "CreateRole": "Role creation", "AssumeRole": "Role assumption",
    "UpdateAssumeRolePolicy": "Trust policy modification", "CreateLoginProfile": "Console access granted",
    "UpdateLoginProfile": "Password change", "DeleteLoginProfile": "Console access removed",
    "AttachRolePolicy": "Role policy attachment", "PutRolePolicy": "Inline role policy",
    "CreatePolicyVersion": "Policy version creation", "SetDefaultPolicyVersion": "Policy version change",
    "PassRole": "Role passing", "GetSecretValue": "Secret access", "Decrypt": "KMS decryption",
    "GetParameter": "SSM parameter access", "GetParameters": "Bulk parameter access",
    "AuthorizeSecurityGroupIngress": "Firewall rule added", "AuthorizeSecurityGroupEgress": "Outbound rule added",
    "CreateSecurityGroup": "Security group created", "ModifyInstanceAttribute": "Instance modified",
    "CreateVpcPeering": "VPC peering created", "DeleteBucket": "S3 bucket deleted",
    "DeleteDBInstance": "Database deleted", "TerminateInstances": "EC2 instances terminated",
    "DeleteAccessKey": "Access key deleted", "DeleteUser": "User deleted", "StopLogging": "CloudTrail disabled",
    "DeleteTrail": "CloudTrail deleted", "PutEventSelectors": "CloudTrail modified",
    "DisableAlarmActions": "Alarms disabled", "DeleteAlarms": "Alarms deleted",
}
SUSPICIOUS_ERRORS = (
    "UnauthorizedOperation", "AccessDenied", "TokenRefreshRequired", "CredentialsNotFound", "InvalidUserID.NotFound",
    "AuthFailure", "UnauthorizedAccess", "Forbidden",
)


def identity(user_name, arn, principal, account):
    """Who made a call: name, last part of the resource name, principal, or account."""
    return F.coalesce(
        user_name,
        F.element_at(F.split(arn, "/+"), -1),
        principal,
        F.concat(F.lit("Account-"), account),
        F.lit("Unknown"),
    )


def call_severity(event_name, error_code):
    return (
        F.when(error_code.isin(*SUSPICIOUS_ERRORS), "critical")
        .when((error_code != "") | event_name.isin(*HIGH_RISK_CALLS), "warning")
        .otherwise("info")
    )


RECORD = (
    "eventTime string, eventName string, eventSource string, userIdentity struct<userName: string, arn: string, principalId: string, "
    "accountId: string, type: string, accessKeyId: string>, sourceIPAddress string, userAgent string, awsRegion string, errorCode string, "
    "errorMessage string, requestParameters string, eventID string"
)


def calls(records: DataFrame, obj: str = "object", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Audit records as typed calls; a record is parsed once, and only for the fields asked for."""
    parsed = records.select(*keep, F.from_json(F.col(obj), RECORD).alias("_r"))
    r = lambda name: F.col(f"_r.{name}")
    inner = lambda name: F.col(f"_r.userIdentity.{name}")
    or_unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    typed = parsed.select(
        *keep,
        normalize_timestamp(r("eventTime")).alias("ts"),
        or_unknown(r("eventName")).alias("event_name"),
        or_unknown(r("eventSource")).alias("event_source"),
        identity(inner("userName"), inner("arn"), inner("principalId"), inner("accountId")).alias("user"),
        or_unknown(inner("type")).alias("user_type"),
        or_unknown(inner("accountId")).alias("account_id"),
        or_unknown(inner("accessKeyId")).alias("access_key_id"),
        or_unknown(r("sourceIPAddress")).alias("source_ip"),
        or_empty(r("userAgent")).alias("user_agent"),
        or_unknown(r("awsRegion")).alias("region"),
        or_empty(r("errorCode")).alias("error_code"),
        or_empty(r("errorMessage")).alias("error_message"),
        or_empty(r("requestParameters")).alias("request_parameters"),
        r("eventID").alias("event_id"),
    )
    return with_risk(typed)


def with_risk(typed: DataFrame) -> DataFrame:
    risk = lookup(F.col("event_name"), HIGH_RISK_CALLS)
    error = F.col("error_code")
    tags = F.array_compact(
        F.array(
            F.when(risk.isNotNull(), F.lit("high_risk_api")),
            F.when(risk.isNotNull(), F.replace(F.lower(risk), F.lit(" "), F.lit("_"))),
            F.when(error != "", F.lit("error")),
            F.when(error.isin(*SUSPICIOUS_ERRORS), F.lit("suspicious_error")),
        )
    )
    message = F.concat(
        "event_name", F.lit(" by "), "user", F.lit(" from "), "source_ip",
        F.when(error != "", F.concat(F.lit(" - ERROR: "), error)).otherwise(F.lit("")),
    )
    return typed.withColumns(
        {"severity": call_severity(F.col("event_name"), error), "risk": risk, "message": message, "tags": tags}
    )


def read_cloudtrail(spark: SparkSession, path: str) -> DataFrame:
    """Audit files, plain or gzip, with `Records`, a list or objects; plain ones are read by split whatever their size."""
    elements, texts = read_json_records(spark, path, ("Records", *ENVELOPES))
    wrapped = texts.withColumn("text", F.coalesce(F.get_json_object("text", "$.Records"), F.col("text")))
    return calls(elements.unionByName(objects(wrapped)))
