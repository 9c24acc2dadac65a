"""Phishing score over a table of decoded mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import net
from logsieve.functions.text import contains_any, is_homograph

# fixed values: words, endings, header patterns and points
WORDS = {
    "urgency_words": (
        "urgent", "immediate", "expire", "suspend", "deadline", "limited time", "act now", "verify account", "confirm identity",
    ),
    "credential_words": (
        "password", "username", "pin", "ssn", "social security", "credit card", "account number", "routing number", "cvv",
    ),
    "financial_words": (
        "payment", "invoice", "refund", "tax", "irs", "hmrc", "wire transfer", "bitcoin", "cryptocurrency", "wallet",
    ),
    "threat_words": (
        "locked", "blocked", "suspended", "disabled", "unauthorized", "security alert", "breach", "compromised", "illegal",
    ),
}
HEADER_CHECKS = {
    "spf_fail": r"(?i)spf=fail|spf=softfail", "dkim_fail": r"(?i)dkim=fail", "dmarc_fail": r"(?i)dmarc=fail",
    "suspicious_received": r"(?i)forged|spoofed|localhost|127\.0\.0\.1",
    "suspicious_mailer": r"(?i)PHPMailer|Python|bulk\s*mailer|mass\s*mail",
}
BAD_ENDINGS = (
    ".exe", ".scr", ".vbs", ".js", ".jar", ".bat", ".cmd", ".com", ".pif", ".lnk", ".ps1", ".reg", ".hta", ".iso", ".img", ".rar", ".ace",
)
DECOY_ENDINGS = ("jpg", "pdf", "doc", "txt")
SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "short.link", "t.co", "tiny.cc", "is.gd", "buff.ly", "y2u.be",
)
BAD_TLDS = (".tk", ".ml", ".ga", ".cf", ".click", ".download", ".bid")
FORM_WORDS = ("password", "pin", "ssn", "credit")
POINTS = {
    "header": 20, "received": 15, "mailer": 10, "mismatch": 25, "word": 5, "shortener": 15, "homograph": 25, "tld": 20,
    "ip_url": 20, "form": 40, "attachment": 30, "double_extension": 35,
}
BANDS = (
    (100, "CRITICAL - Very likely phishing"), (70, "HIGH - Likely phishing"), (40, "MEDIUM - Possible phishing"),
    (20, "LOW - Some suspicious indicators"),
)
URL = r'https?://[^\s<>"{}|\\^`\[\]]+'


def _sum(array: Column, score) -> Column:
    return F.aggregate(array, F.lit(0), lambda total, x: total + score(x))


def url_points(url: Column) -> Column:
    """Points of the first sign that applies to a URL."""
    host = net.url_host(url)
    tld = F.lit(False)
    for t in BAD_TLDS:
        tld = tld | host.endswith(t)
    return (
        F.when(contains_any(host, SHORTENERS), POINTS["shortener"]).when(is_homograph(host), POINTS["homograph"])
        .when(tld, POINTS["tld"]).when(host.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), POINTS["ip_url"]).otherwise(0)
    )


def attachment_points(name: Column) -> Column:
    lowered = F.lower(name)
    bad = F.lit(False)
    for e in BAD_ENDINGS:
        bad = bad | lowered.endswith(e)
    parts = F.split(lowered, r"\.")
    double = (F.size(parts) >= 3) & F.get(parts, F.size(parts) - 2).isin(*DECOY_ENDINGS)
    return F.when(bad, POINTS["attachment"]).otherwise(0) + F.when(double, POINTS["double_extension"]).otherwise(0)


def word_hits(body: Column) -> dict[str, Column]:
    lowered = F.lower(body)
    out = {}
    for group, words in WORDS.items():
        hits = F.lit(0)
        for w in words:
            hits = hits + lowered.contains(w).cast("int")
        out[group] = hits
    return out


def phishing_score(mails: DataFrame) -> DataFrame:
    """Mails with points per sign, total and band.

    Columns: sender, return_path, auth_results, mailer (text), received, attachments
    (arrays of text), body_text, body_html.
    """
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    listed = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>"))
    body = F.concat_ws(" ", text("body_text"), text("body_html"))
    sender, back = net.email_address(text("sender")), net.email_address(text("return_path"))
    header = F.lit(0)
    # every check is made against the authentication results
    for pattern in HEADER_CHECKS.values():
        header = header + F.when(text("auth_results").rlike(pattern), POINTS["header"]).otherwise(0)
    forms = F.regexp_extract_all(text("body_html"), F.lit(r"(?is)<form[^>]*>(.*?)</form>"), F.lit(1))
    hits = word_hits(body)
    words = F.lit(0)
    for c in hits.values():
        words = words + c
    scored = mails.withColumns(
        {
            "header_points": header,
            "received_points": _sum(listed("received"), lambda r: F.when(r.rlike(HEADER_CHECKS["suspicious_received"]), POINTS["received"]).otherwise(0)),
            "mailer_points": F.when(text("mailer").rlike(HEADER_CHECKS["suspicious_mailer"]), POINTS["mailer"]).otherwise(0),
            "mismatch_points": F.when((sender != "") & (back != "") & (sender != back) & ~net.same_domain(sender, back), POINTS["mismatch"]).otherwise(0),
            "word_points": words * POINTS["word"],
            "url_points": _sum(F.array_distinct(F.regexp_extract_all(body, F.lit(URL), F.lit(0))), url_points),
            "form_points": _sum(forms, lambda f: F.when(contains_any(F.lower(f), FORM_WORDS), POINTS["form"]).otherwise(0)),
            "attachment_points": _sum(listed("attachments"), attachment_points),
        }
    )
    total = F.lit(0)
    for name in ("header", "received", "mailer", "mismatch", "word", "url", "form", "attachment"):
        total = total + F.col(f"{name}_points")
    band = F.lit("SAFE - No significant threats detected")
    for bound, label in reversed(BANDS):
        band = F.when(F.col("phishing_score") >= bound, label).otherwise(band)
    return scored.withColumn("phishing_score", total).withColumn("assessment", band)


def word_groups(mails: DataFrame, keep: tuple[str, ...], body: str = "body_text", at_least: int = 3) -> DataFrame:
    """Mails with several words of one group."""
    from logsieve.functions.rows import explode_computed

    groups = F.array_compact(
        F.array(*[F.when(c >= at_least, F.struct(F.lit(g).alias("word_group"), c.alias("words"))) for g, c in word_hits(F.col(body)).items()])
    )
    return explode_computed(mails, keep, groups, "_g").select(*keep, "_g.*")


def auth_results(mails: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return mails.select(
        *keep, *[F.nullif(F.regexp_extract(F.coalesce("auth_results", F.lit("")), rf"{n}=(\w+)", 1), F.lit("")).alias(n) for n in ("spf", "dkim", "dmarc")]
    )
