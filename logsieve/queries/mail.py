"""Mails made of conversation turns, scored for phishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve import adapt
from logsieve.functions import text as txt
from logsieve.operators import mail
from logsieve.queries import sqlkit as s
from logsieve.queries.registry import query

EXTRA = (
    "please verify account now, urgent: account number and password expire http://bit.ly/x1", "invoice payment refund tax http://google0.com/a",
    "hello http://login.evil.tk/p and http://10.1.2.3/q", "nothing here", "your wallet is locked and suspended",
)
FORM = '<html><form action="/x"><input name="Password"></form><form>plain</form></html>'


def mails(spark, sf_dir):
    n = F.col("conv_id") * 7 + F.col("turn")
    pick = lambda xs: F.element_at(F.array(*xs), (n % len(xs) + 1).cast("int"))
    lit = lambda *xs: [F.lit(x) for x in xs]
    return adapt.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", pick(lit("Bob <bob@corp.com>", "eve@evil.net", "a@mail.corp.com")).alias("sender"),
        pick(lit("<bob@corp.com>", "x@corp.com")).alias("return_path"), pick(lit("spf=fail dkim=pass", "spf=pass dkim=fail dmarc=fail", "spf=pass", "")).alias("auth_results"),
        pick(lit("PHPMailer 5", "Outlook", "bulk  mailer")).alias("mailer"),
        pick([F.array(F.lit("from localhost"), F.lit("by relay")), F.array(F.lit("ok")), F.array(F.lit("forged"), F.lit("from 127.0.0.1"))]).alias("received"),
        pick([F.array(F.lit("a.pdf.exe")), F.array().cast("array<string>"), F.array(F.lit("photo.png"), F.lit("run.JS"))]).alias("attachments"),
        F.concat(F.col("text"), F.lit(" "), pick(lit(*EXTRA))).alias("body_text"), F.when(n % 3 == 0, FORM).otherwise("").alias("body_html"),
    )


def _pick(*xs):
    return f"[{', '.join(s.text(x) for x in xs)}][n % {len(xs)} + 1]"


BODY = "lower(text || ' ' || extra || ' ' || html)"
MAIL_SQL = f"""WITH m0 AS (SELECT *, conv_id * 7 + turn AS n FROM conversations), m1 AS (SELECT *, {_pick(*EXTRA)} AS extra, CASE WHEN n % 3 = 0 THEN {s.text(FORM)} ELSE '' END AS html,
    {_pick("spf=fail dkim=pass", "spf=pass dkim=fail dmarc=fail", "spf=pass", "")} AS auth FROM m0),
  m AS (SELECT conv_id, turn, n, text, extra, auth,
    CASE n % 4 WHEN 0 THEN 20 WHEN 1 THEN 40 ELSE 0 END AS header_points, CASE n % 3 WHEN 0 THEN 15 WHEN 2 THEN 30 ELSE 0 END AS received_points,
    CASE n % 3 WHEN 1 THEN 0 ELSE 10 END AS mailer_points, CASE WHEN n % 3 = 1 THEN 25 ELSE 0 END AS mismatch_points,
    5 * ({' + '.join(f"CAST(contains({BODY}, {s.text(w)}) AS INTEGER)" for ws in mail.WORDS.values() for w in ws)}) AS word_points,
    list_sum([0] || list_transform(list_distinct(regexp_extract_all(text || ' ' || extra || ' ' || html, {s.text(mail.URL)})), lambda u:
       CASE WHEN contains(u, 'bit.ly') THEN 15 WHEN contains(u, 'google0.com') THEN 25 WHEN contains(u, '.tk/') THEN 20 WHEN contains(u, '10.1.2.3') THEN 20 ELSE 0 END)) AS url_points,
    CASE WHEN n % 3 = 0 THEN 40 ELSE 0 END AS form_points, CASE n % 3 WHEN 0 THEN 65 WHEN 2 THEN 30 ELSE 0 END AS attachment_points FROM m1),
  t AS (SELECT *, header_points + received_points + mailer_points + mismatch_points + word_points + url_points + form_points + attachment_points AS total FROM m)"""
NAMES = ("header", "received", "mailer", "mismatch", "word", "url", "form", "attachment")


@query(
    "phishing_score",
    MAIL_SQL + " SELECT conv_id, turn, " + ", ".join(f"CAST({n}_points AS INTEGER) AS {n}_points" for n in NAMES)
    + """, CAST(total AS INTEGER) AS phishing_score, CASE WHEN total >= 100 THEN 'CRITICAL - Very likely phishing' WHEN total >= 70 THEN 'HIGH - Likely phishing'
    WHEN total >= 40 THEN 'MEDIUM - Possible phishing' WHEN total >= 20 THEN 'LOW - Some suspicious indicators' ELSE 'SAFE - No significant threats detected' END AS assessment FROM t""",
)
def phishing_score(spark, sf_dir):
    found = mail.phishing_score(mails(spark, sf_dir))
    return found.select("conv_id", "turn", *[f"{n}_points" for n in NAMES], "phishing_score", "assessment")


@query(
    "phishing_word_groups",
    MAIL_SQL + " " + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{g}' AS word_group, w AS words FROM (SELECT conv_id, turn, {' + '.join(f'''CAST(contains(lower(text || ' ' || extra), {s.text(w)}) AS INTEGER)''' for w in ws)} AS w FROM m) WHERE w >= 3"
        for g, ws in mail.WORDS.items()
    ),
)
def phishing_word_groups(spark, sf_dir):
    return mail.word_groups(mails(spark, sf_dir), ("conv_id", "turn"))


@query(
    "mail_auth_results",
    MAIL_SQL + """ SELECT conv_id, turn, coalesce(nullif(regexp_extract(auth, 'spf=(\\w+)', 1), ''), 'none') AS spf, coalesce(nullif(regexp_extract(auth, 'dkim=(\\w+)', 1), ''), 'none') AS dkim,
    coalesce(nullif(regexp_extract(auth, 'dmarc=(\\w+)', 1), ''), 'none') AS dmarc FROM m""".replace("\\\\", "\\"),
)
def mail_auth_results(spark, sf_dir):
    found = mail.auth_results(mails(spark, sf_dir), ("conv_id", "turn"))
    return found.select("conv_id", "turn", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("spf", "dkim", "dmarc")])


@query(
    "mail_homographs",
    MAIL_SQL + f""" SELECT conv_id, turn, regexp_extract(extra, 'https?://([^/ ]+)', 1) AS host,
    {s.has_any("regexp_extract(extra, 'https?://([^/ ]+)', 1)", txt.HOMOGRAPH_BRANDS)} AND {s.has_any("regexp_extract(extra, 'https?://([^/ ]+)', 1)", txt.HOMOGRAPH_CHARS)} AS homograph
    FROM m WHERE contains(extra, 'http')""",
)
def mail_homographs(spark, sf_dir):
    n = (F.col("conv_id") * 7 + F.col("turn")) % len(EXTRA)
    extra = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), (n + 1).cast("int"))
    hosts = adapt.table(spark, sf_dir, "conversations").select("conv_id", "turn", extra.alias("e")).where(F.col("e").contains("http"))
    host = F.regexp_extract("e", "https?://([^/ ]+)", 1)
    return hosts.select("conv_id", "turn", host.alias("host"), txt.is_homograph(host).alias("homograph"))
