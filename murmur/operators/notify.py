"""Notification routing and payloads as an outbox table.

Delivery (SMTP, HTTP) is outside Spark: the outbox is what a sender reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, icons and message layouts of the notifications.
SEVERITY_LABELS = {"critical": "严重", "warning": "警告", "info": "提示"}
TYPE_LABELS = {"negative_surge": "负面舆情突增", "keyword_trigger": "敏感词触发",
               "topic_growth": "话题异常增长"}
ICON_CRITICAL = "🔴"
ICON_OTHER = "🟡"
HEADLINE = "舆情预警"
EMAIL_SUBJECT_PREFIX = "[舆情预警] "
EMAIL_HEADER = "舆情分析平台预警通知\n========================\n\n"
EMAIL_FOOTER = "\n请及时处理。\n"


def _label(c: Column, labels: dict) -> Column:
    expr = None
    for k, v in labels.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(c)


def severity_label(c: Column) -> Column:
    """T14"""
    return _label(c, SEVERITY_LABELS)


def type_label(c: Column) -> Column:
    """T14"""
    return _label(c, TYPE_LABELS)


def iso_time_text(ts: Column) -> Column:
    """ISO text of a wall-clock time as the alert messages print it:
    ``yyyy-MM-ddTHH:mm``, then ``:ss`` unless seconds and fraction are zero,
    then ``.SSS`` or ``.SSSSSS`` (shortest exact)."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
    sec = F.date_format(ts, "ss")
    frac = F.date_format(ts, "SSSSSS")
    tail = (F.when((sec == "00") & (frac == "000000"), F.lit(""))
             .when(frac == "000000", F.concat(F.lit(":"), sec))
             .when(F.substring(frac, 4, 3) == "000",
                   F.concat(F.lit(":"), sec, F.lit("."), F.substring(frac, 1, 3)))
             .otherwise(F.concat(F.lit(":"), sec, F.lit("."), frac)))
    return F.when(ts.isNotNull(), F.concat(base, tail)).otherwise(F.lit("null"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit("null"))


def notification_outbox(alerts: DataFrame, webhook_type: str = "wechat",
                        email_enabled: bool = True, webhook_enabled: bool = True) -> DataFrame:
    """One row per (alert, channel): info -> nothing; critical -> e-mail;
    warning and critical -> webhook in the chosen chat dialect."""
    sev = F.col("severity")
    when_ = _text(iso_time_text(F.col("created_at")))
    slabel, tlabel = severity_label(sev), type_label(F.col("alert_type"))
    desc = _text(F.col("description"))
    email_body = F.concat(F.lit(EMAIL_HEADER),
                          F.lit("级别: "), slabel, F.lit("\n"),
                          F.lit("类型: "), tlabel, F.lit("\n"),
                          F.lit("标题: "), _text(F.col("title")), F.lit("\n"),
                          F.lit("详情: "), desc, F.lit("\n"),
                          F.lit("时间: "), when_, F.lit("\n"),
                          F.lit(EMAIL_FOOTER))
    email = F.to_json(F.struct(F.concat(F.lit(EMAIL_SUBJECT_PREFIX), _text(F.col("title"))).alias("subject"),
                               email_body.alias("text")))
    if webhook_type.lower() == "dingtalk":
        content = F.concat(F.lit("### " + HEADLINE + "\n- 级别: **"), slabel, F.lit("**\n- 类型: "), tlabel,
                           F.lit("\n- 详情: "), desc, F.lit("\n- 时间: "), when_)
        hook = F.to_json(F.struct(F.lit("markdown").alias("msgtype"),
                                  F.struct(F.lit(HEADLINE).alias("title"), content.alias("text")).alias("markdown")))
    else:
        icon = F.when(sev == "critical", ICON_CRITICAL).otherwise(ICON_OTHER)
        content = F.concat(F.lit("### "), icon, F.lit(" " + HEADLINE + "\n> 级别: **"), slabel,
                           F.lit("**\n> 类型: "), tlabel, F.lit("\n> 详情: "), desc,
                           F.lit("\n> 时间: "), when_)
        hook = F.to_json(F.struct(F.lit("markdown").alias("msgtype"),
                                  F.struct(content.alias("content")).alias("markdown")))
    chans = []
    if email_enabled:
        chans.append(F.when(sev == "critical", F.struct(F.lit("email").alias("channel"), email.alias("payload"))))
    if webhook_enabled:
        chans.append(F.when(sev.isin("warning", "critical"),
                            F.struct(F.lit("webhook").alias("channel"), hook.alias("payload"))))
    if not chans:
        return alerts.select(F.col("id").alias("alert_id"), F.lit("").alias("channel"),
                             F.lit("").alias("payload")).limit(0)
    arr = F.filter(F.array(*chans), lambda x: x.isNotNull())
    return (alerts.select(F.col("id").alias("alert_id"), F.explode(arr).alias("m"))
                  .select("alert_id", "m.channel", "m.payload"))


def notified_flags(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``notified`` = any channel of the alert delivered (``ok``)."""
    d = deliveries.groupBy("alert_id").agg(F.bool_or("ok").alias("_ok"))
    return (alerts.join(d, alerts["id"] == d["alert_id"], "left")
                  .select(alerts["id"].alias("alert_id"),
                          (F.coalesce(F.col("_ok"), F.lit(False)) | F.coalesce(alerts["notified"], F.lit(False)))
                          .alias("notified")))
