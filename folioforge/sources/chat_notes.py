"""Conversations as Markdown notes and HTML pages per platform; activity and notebook exports as conversations.

All of it is Columns and grouping: a conversation is one row of output, so its turns meet in one row and no more than that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as life
from . import notes

#: Platforms: how the answering side is called, and where the platform lives. Fixed values.
PLATFORMS = {"chatgpt": ("ChatGPT", "chatgpt.com"), "claude": ("Claude", "claude.ai"), "gemini": ("Gemini", "gemini.google.com"), "grok": ("Grok", "grok.com")}
#: Tags that a chat note carries. Fixed values.
NOTE_TAGS = ("chat-protokoll", "KI-generiert")
#: Markdown for inline and block tags. Fixed values.
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def local_time(text: Column) -> Column:
    """The first time in a text that is written the German way (14.03.2026, 13:08:30) or the English way (Mar 14, 2026, 1:08:30 PM).

    Zones are not read: the time is the one that the text names. Days that there aren't give null.
    """
    german = F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4}),?\s+\d{2}:\d{2}:\d{2}", 1)
    clock = F.regexp_extract(text, r"\d{2}\.\d{2}\.\d{4},?\s+(\d{2}:\d{2}:\d{2})", 1)
    english = r"([A-Za-z]{3})\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d{2}:\d{2})\s*([AaPp][Mm])?"
    part = lambda k: F.regexp_extract(text, english, k)
    hour, half = part(4).try_cast("int"), F.upper(part(6))
    full = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    written = F.concat_ws(" ", F.initcap(part(1)), F.lpad(part(2), 2, "0"), part(3), F.concat(F.lpad(full.cast("string"), 2, "0"), F.lit(":"), part(5)))
    return F.when(german != "", F.try_to_timestamp(F.concat(german, F.lit(" "), clock), F.lit("dd.MM.yyyy HH:mm:ss"))).when(part(3) != "", F.try_to_timestamp(written, F.lit("MMM dd yyyy HH:mm:ss")))


def html_to_markdown(html: Column) -> Column:
    """Markdown of an HTML fragment: headings, paragraphs, breaks, emphasis, links, list items and rules; other tags go.

    Tags that hold nothing but white space leave no marks. Null is the empty text.
    """
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "")
    for k in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{k}\b[^>]*>\s*(.*?)\s*</h{k}\s*>", "\n\n" + "#" * min(k, 5) + " $1\n\n")
    for tag, mark in MARKS.items():
        out = F.regexp_replace(F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>\s*</{tag}\s*>", ""), rf"(?is)<{tag}(?:\s[^>]*)?>\s*(.*?)\s*</{tag}\s*>", mark.replace("*", r"\*") + "$1" + mark.replace("*", r"\*"))
    out = F.regexp_replace(out, r"""(?is)<a\s[^>]*?href=["']([^"']+)["'][^>]*>\s*</a\s*>""", "[$1]($1)")
    out = F.regexp_replace(out, r"""(?is)<a\s[^>]*?href=["']([^"']+)["'][^>]*>\s*(.*?)\s*</a\s*>""", "[$2]($1)")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<li\b[^>]*>\s*", "\n- "), r"(?i)<(?:ul|ol)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</(?:ul|ol)\s*>", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<hr\b[^>]*>", "\n---\n\n"), r"(?i)<br\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?p\b[^>]*>", "\n\n"), r"<[^<>]+>", "")
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def front_matter(fields: Mapping[str, Column]) -> Column:
    """A block of YAML: numbers as they are, lists in brackets, other values as quoted text; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: T.json_string(x)), ", "), F.lit("]"))


def _conversations(turns: DataFrame, said: Column, between: str) -> DataFrame:
    """conv_id, its turns' texts in order, how many, and what was asked first; turns that say nothing don't count."""
    rows = turns.filter(F.col("role").isin("user", "assistant") & (T.strip(F.col("text")) != ""))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said"), F.when(F.col("role") == "user", F.col("text")).alias("asked")))).alias("t"))
    first = F.get(F.filter(F.transform("t", lambda x: x["asked"]), lambda x: x.isNotNull()), 0)
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), between).alias("body"), F.size("t").alias("message_count"), first.alias("asked"))


def short_title(text: Column, longest: int = 60) -> Column:
    """The first line of what was asked, cut at the last blank before the limit."""
    line = F.regexp_replace(T.strip(F.substring_index(T.strip(text), "\n", 1)), r"(?U)\s+", " ")
    cut = F.substring(line, 1, longest)
    return F.when(F.length(line) <= longest, line).when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)


def _titled(made: DataFrame, about: DataFrame | None) -> DataFrame:
    """made with title, created and updated: the export's own, else the title from the first question."""
    if about is None:
        out = made.withColumns({"title": F.lit(None).cast("string"), "created": F.lit(None).cast("timestamp"), "updated": F.lit(None).cast("timestamp")})
    else:
        has = set(about.columns)
        own = about.select("conv_id", *[(F.col(c) if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in (("title", "string"), ("created", "timestamp"), ("updated", "timestamp"))])
        out = made.join(own, "conv_id", "left")
    return out.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), short_title(F.col("asked")), F.lit("Untitled")))


def to_notes(turns: DataFrame, platform: str, about: DataFrame | None = None) -> DataFrame:
    """conv_id, folder, name and markdown of a note for each conversation that says something.

    turns: conv_id, turn, role, text; about: conv_id and any of title, created, updated, one row a conversation. The folder is
    the month, the name the day, the platform and the title; without a time both say so. System turns are left out. Turns without a conv_id are one conversation, which has no title of its own.
    """
    speaker, site = PLATFORMS[platform]
    label = F.when(F.col("role") == "user", "**User:**").otherwise(f"**{speaker}:**")
    rows = _titled(_conversations(turns, F.concat(label, F.lit("\n"), T.strip(F.col("text"))), "\n\n"), about)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    created = F.coalesce(day("created"), F.lit("unknown"))
    title = F.replace(F.col("title"), F.lit('"'), F.lit("'"))
    head = front_matter({
        "title": F.concat(F.lit('"'), title, F.lit('"')), "authors": F.lit(f"[{speaker}]"), "tags": F.lit(f"[{', '.join(NOTE_TAGS)}]"), "type": F.lit("chat"),
        "source_llm": F.lit(platform), "source_platform": F.lit(site), "created": created, "modified": day("updated"), "message_count": F.col("message_count").cast("string"),
    })
    name = F.concat(created, F.lit(f"_{platform}_"), T.slug(F.col("title")), F.lit(".md"))
    return rows.select("conv_id", notes.month_folder(F.col("created")).alias("folder"), name.alias("name"), F.concat(head, F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("markdown"))


def code_to_html(text: Column) -> Column:
    """Text escaped for HTML; fenced blocks become pre, back-ticked spans code. A fence that isn't closed stays text."""
    fence = "```"
    parts = F.split(text, fence)
    inline = lambda x: F.regexp_replace(T.escape_xml(x), r"`([^`\n]+)`", "<code>$1</code>")

    def block(x: Column) -> Column:
        language = F.regexp_extract(x, r"^(\w*)\n", 1)
        code = F.regexp_replace(F.regexp_replace(x, r"^\w*\n", ""), r"\s+$", "")
        kind = F.when(language != "", F.concat(F.lit(' class="language-'), language, F.lit('"'))).otherwise("")
        return F.concat(F.lit("<pre><code"), kind, F.lit(">"), T.escape_xml(code), F.lit("</code></pre>"))

    open_end = F.size(parts) % 2 == 0  # an odd number of fences: the last one opens nothing
    made = F.transform(parts, lambda x, i: F.when(i % 2 == 0, inline(x)).when(open_end & (i == F.size(parts) - 1), F.concat(F.lit(fence), inline(x))).otherwise(block(x)))
    return F.array_join(made, "")


def to_pages(turns: DataFrame, platform: str, about: DataFrame | None = None) -> DataFrame:
    """conv_id, title and html: a page of each conversation that says something, a block for each turn."""
    speaker = PLATFORMS[platform][0]
    who = F.when(F.col("role") == "user", "You").otherwise(speaker)
    block = F.concat(F.lit('<section class="turn '), "role", F.lit('"><h2>'), who, F.lit("</h2><div>"), code_to_html(F.col("text")), F.lit("</div></section>"))
    rows = _titled(_conversations(turns, block, "\n<hr>\n"), about)
    day = F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit("unknown date"))
    title = T.escape_xml(F.col("title"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>\n<h1>"), title, F.lit(f"</h1>\n<p>{speaker}, "), day, F.lit("</p>\n"))
    return rows.select("conv_id", "title", F.concat(head, "body", F.lit("\n</body></html>\n")).alias("html"))


def activity_turns(entries: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """conv_id, turn, role, text, ts of an activity log (file, k, prompt, reply, ts), which names no conversations.

    Entries of a file in order of time are one conversation until a pause that is strictly longer than the gap. Prompts and replies that are
    empty give no turn. Entries without a time come last in the file's last conversation.
    """
    met = life.sessions(entries, "file", "ts", "k", gap_minutes)
    side = lambda kind, text, n: F.struct(F.lit(kind).alias("role"), F.col(text).alias("text"), F.lit(n).alias("n"))
    rows = met.select(F.concat_ws("#", "file", F.col("session").cast("string")).alias("conv_id"), "ts", "k", F.explode(F.array(side("user", "prompt", 0), side("assistant", "reply", 1))).alias("s"))
    return rows.filter(T.strip(F.coalesce("s.text", F.lit(""))) != "").select("conv_id", F.struct(F.coalesce(F.unix_micros("ts"), F.lit(2**63 - 1)).alias("us"), "k", "s.n").alias("turn"), "s.role", "s.text", "ts")


def notebook_kind(file: Column, value: Column) -> Column:
    """chat or note: by the file's name, else by lines that begin with a speaker."""
    stem = F.lower(F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1))
    return F.when(stem.contains("chat") | value.rlike(r"(?im)^(model|user)\s*:"), "chat").otherwise("note")


def notebook_markdown(value: Column) -> Column:
    """A notebook's saved chat, lines that begin with USER: or MODEL:, as a dialogue; files without such lines as Markdown.

    Lines before the first speaker are left out, turns that say nothing too.
    """
    turns = F.split(value, r"(?im)^(?=(?:model|user)\s*:)")
    spoken = F.filter(turns, lambda x: x.rlike(r"(?i)^(model|user)\s*:"))

    def one(x: Column) -> Column:
        said = html_to_markdown(F.regexp_replace(x, r"(?i)^(model|user)\s*:", ""))
        return F.when(said != "", F.concat(F.when(F.lower(F.substring(x, 1, 4)) == "user", "**User:**\n").otherwise(f"**{PLATFORMS['gemini'][0]}:**\n"), said))

    return F.when(F.size(spoken) > 0, F.array_join(F.transform(spoken, one), "\n\n")).otherwise(html_to_markdown(value))


def notebook_notes(files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """file, kind and markdown with front matter of a notebook's files (file, notebook, value).

    sources: notebook, title and url of what the notebook draws on (discovered sources), listed in the front matter by title.
    """
    rows = files.withColumns({"kind": notebook_kind(F.col("file"), F.col("value")), "body": notebook_markdown(F.col("value"))})
    if sources is not None:
        ref = F.coalesce(F.nullif(F.concat_ws(" ", "title", "url"), F.lit("")), F.lit("untitled"))
        rows = rows.join(sources.groupBy("notebook").agg(F.array_sort(F.collect_set(ref)).alias("sources")), "notebook", "left")
    drawn = listed(F.col("sources")) if sources is not None else F.lit(None).cast("string")
    title = T.url_decoded(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    head = front_matter({"title": T.json_string(title), "notebook": T.json_string(F.col("notebook")), "type": F.col("kind"), "sources": drawn})
    return rows.select("file", "kind", F.concat(head, "body", F.lit("\n")).alias("markdown"))
