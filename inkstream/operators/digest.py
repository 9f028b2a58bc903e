"""A day's digest as a mail: subject, plain text and HTML for each group of readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.text import escape_html

#: Tags of a digest's links, the mark before them and the rule between parts of the text.
CAMPAIGN = (("utm_source", "newsletter"), ("utm_medium", "email"), ("utm_campaign", "daily-digest"))
RULE = "─" * 20
BLOCK = 100  # items that are joined first, before the blocks of a digest are


@dataclass(frozen=True)
class Masthead:
    name: str
    site: str
    home: str
    contact: str
    lead: str = "The day's reading."


def article_link(site: str, slug: Column) -> Column:
    tags = "&".join(f"{k}={v}" for k, v in CAMPAIGN)
    return F.concat(F.lit(f"{site}/news/"), slug, F.lit(f"?{tags}"))


def _joined(rows: DataFrame, parts: dict[str, Column], between: str) -> DataFrame:
    """One text of each part for each group, its items in order of n: joined in blocks, then the blocks."""
    lists = [F.expr(f"listagg({c}, '{between}') WITHIN GROUP (ORDER BY n)").alias(c) for c in parts]
    items = rows.select("group", "n", F.floor((F.col("n") - 1) / BLOCK).alias("block"), *[p.alias(c) for c, p in parts.items()])
    blocks = items.groupBy("group", "block").agg(F.count(F.lit(1)).alias("size"), *lists)
    whole = [F.expr(f"listagg({c}, '{between}') WITHIN GROUP (ORDER BY block)").alias(c) for c in parts]
    return blocks.groupBy("group").agg(F.sum("size").alias("size"), *whole)


def documents(articles: DataFrame, masthead: Masthead, day: str) -> DataFrame:
    """group, subject, text and html of ``articles`` (group, n, slug, title, subtitle, category), numbered from 1 in each group.

    ``day`` is yyyy-MM-dd. A missing subtitle or category is empty. A group is the news of a day, so its document is
    one row; a group without articles has none.
    """
    number, link = F.lpad("n", F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), "0"), article_link(masthead.site, F.col("slug"))
    title, subtitle, category = (F.coalesce(c, F.lit("")) for c in ("title", "subtitle", "category"))
    line = F.concat(number, F.lit(". "), title, F.lit("\n"), subtitle, F.lit("\n→ "), link, F.lit("\n"))
    row = F.concat(
        F.lit("<tr><td><small>"), number, F.lit(" · "), escape_html(category), F.lit('</small><br><a href="'), link, F.lit('"><b>'), escape_html(title),
        F.lit("</b></a><p>"), escape_html(subtitle), F.lit("</p></td></tr>"),
    )
    first = F.when(F.col("n") == 1, subtitle)
    leads = articles.groupBy("group").agg(F.max(first).alias("lead")).withColumnRenamed("group", "g")
    found = _joined(articles, {"lines": line, "rows": row}, "\\n").join(leads, F.col("group").eqNullSafe(F.col("g")))
    when = F.lit(day).cast("date")
    full = F.date_format(when, "EEEE, d MMMM yyyy")
    count = F.concat(F.col("size").cast("string"), F.when(F.col("size") == 1, " article").otherwise(" articles"))
    subject = F.concat(F.lit("Daily Read — "), F.date_format(when, "EEEE, d MMMM"), F.lit(" · "), count)
    home = "&".join(f"{k}={v}" for k, v in (*CAMPAIGN, ("utm_content", "footer-cta")))
    text = F.concat(
        F.lit(f"{masthead.name} — Daily Read\n"), full, F.lit(f"\n\n{RULE}\n\n"), F.col("lines"), F.lit(f"\n{RULE}\n\n{masthead.home}?{home}\n\n{masthead.contact}\n\nUnsubscribe: {{{{ UnsubscribeURL }}}}\n"),
    )
    html = F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Daily Read — '), full, F.lit('</title></head><body><div style="display:none">'),
        escape_html(F.when(F.col("lead") == "", masthead.lead).otherwise(F.col("lead"))), F.lit(f'</div><table role="presentation" width="100%" style="max-width:600px"><tr><th>{masthead.name}<br>'), full,
        F.lit("</th></tr>\n"), F.col("rows"), F.lit(f'\n<tr><td><a href="{masthead.home}?{home}">{masthead.name}</a><br>{masthead.contact}<br><a href="{{{{ UnsubscribeURL }}}}">Unsubscribe</a></td></tr></table></body></html>'),
    )
    return found.select("group", subject.alias("subject"), text.alias("text"), html.alias("html"))
