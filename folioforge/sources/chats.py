"""Chat exports: JSON of several shapes to one table of turns (conv_id, title, turn, role, text, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables

ROLES = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant", "grok": "assistant"}


def role(raw: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.lower(raw)]


def timestamp(raw: Column) -> Column:
    """ISO text, epoch seconds or milliseconds, or a {"$date": {"$numberLong": ms}} value."""
    number = F.coalesce(F.get_json_object(raw, "$['$date']['$numberLong']"), F.get_json_object(raw, "$['$date']"), raw).try_cast("double")
    return F.coalesce(F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_millis((number * 1000).cast("long"))), F.try_to_timestamp(raw))


def clean_rich_tags(text: Column) -> Column:
    """Without render cards and other tags of the rich text kind."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<(grok|x|xai):[a-z]+[^>]*>.*?</\1:[a-z]+>", ""), r"</?(?:grok|x|xai):[a-z]+[^>]*/?>", "")


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, role and text along each conversation's thread: from the root to the last child each time.

    nodes: conv_id, node, parent (the root's is no node), role, text. Each node that is its parent's last child points to it, and
    pointers double: after r rounds a node knows who stands 2**r links above it, so a thread of any length takes as many rounds as
    its length has binary digits. Until a pointer has come to a top no two nodes point to the same one, so no row is hot. The
    thread is what points to the conversation's first root. Nodes in a ring come to no top and are in no thread.
    """
    nodes = tables.settle(nodes)
    ids = nodes.select("conv_id", "node").filter("node IS NOT NULL").distinct()
    last = nodes.groupBy("conv_id", F.col("parent").alias("at")).agg(F.max("node").alias("node"))
    links = last.join(ids.withColumnRenamed("node", "at"), ["conv_id", "at"]).select("conv_id", "node", "at", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("top"))
    tops = ids.join(links.select("conv_id", "node"), ["conv_id", "node"], "left_anti").select("conv_id", "node", F.col("node").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("top"))
    state = tables.settle(links.union(tops))
    n, rounds = state.count(), 0
    while 2**rounds <= n and not state.filter("NOT top").isEmpty():
        above = state.select("conv_id", F.col("node").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("top").alias("__top"))
        moved = state.filter("NOT top").join(above, ["conv_id", "at"]).select("conv_id", "node", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__top").alias("top"))
        state, rounds = tables.settle(state.filter("top").union(moved)), rounds + 1
    rootless = nodes.join(ids.withColumnRenamed("node", "parent"), ["conv_id", "parent"], "left_anti")
    first = rootless.groupBy("conv_id").agg(F.min("node").alias("at"))
    path = state.filter("top").join(first, ["conv_id", "at"]).select("conv_id", "node", F.col("steps").cast("int").alias("depth"))
    return path.join(nodes.select("conv_id", "node", "role", "text"), ["conv_id", "node"]).filter(F.col("role").isin("user", "assistant")).select("conv_id", "depth", "role", "text")


FLAT = "array<struct<uuid:string, name:string, created_at:string, chat_messages:array<struct<sender:string, text:string, created_at:string>>>>"


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Exports with a list of messages for each conversation."""
    raw = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", FLAT)))
    msg = raw.select(F.col("uuid").alias("conv_id"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("turn", "m"))
    return msg.select("conv_id", "title", "turn", role(F.col("m.sender")).alias("role"), clean_rich_tags(F.col("m.text")).alias("text"), timestamp(F.col("m.created_at")).alias("ts")).filter("role IS NOT NULL")


TREE = "array<struct<id:string, title:string, create_time:double, mapping:map<string, struct<id:string, parent:string, children:array<string>, message:struct<author:struct<role:string>, content:struct<parts:array<string>>, create_time:double>>>>>"


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose messages form a tree: the thread through each node's last child."""
    conv = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", TREE)))
    node = conv.select(F.col("id").alias("conv_id"), F.explode("mapping").alias("node", "v"))
    order = node.select("conv_id", "node", F.posexplode_outer("v.children").alias("k", "child"))
    place = order.filter("child IS NOT NULL").groupBy("conv_id", F.col("node").alias("parent")).agg(F.max_by("child", "k").alias("last"))
    rows = node.select("conv_id", "node", F.coalesce(F.col("v.parent"), F.lit("")).alias("parent"), F.col("v.message.author.role").alias("role"), F.array_join(F.col("v.message.content.parts"), "\n").alias("text"))
    kept = rows.join(place, (rows["conv_id"] == place["conv_id"]) & (rows["node"] == place["last"]), "left").drop(place["conv_id"]).drop(place["parent"])
    return flatten_tree(kept.filter("parent = '' OR last IS NOT NULL").drop("last"))


def read_zip(path: str, member: str = "conversations.json") -> str:
    """Text of a member of an export archive: driver-side, one file."""
    import zipfile

    with zipfile.ZipFile(path) as z:
        name = next(n for n in z.namelist() if n.endswith(member))
        return z.read(name).decode("utf-8")


def takeout_entries(pages: DataFrame) -> DataFrame:
    """file, k, prompt, reply, ts of activity pages saved as HTML."""
    cells = F.regexp_extract_all("html", F.lit(r'(?s)<div class="content-cell[^"]*">(.*?)</div>'), F.lit(1))
    from ..functions.text import clean_html

    rows = pages.select("file", F.posexplode(cells).alias("k", "cell"))
    parts = F.split("cell", r"<br\s*/?>")
    return rows.select("file", "k", clean_html(F.get(parts, 0)).alias("prompt"), clean_html(F.array_join(F.slice(parts, 3, 100_000), " ")).alias("reply"), F.try_to_timestamp(clean_html(F.get(parts, 1)), F.lit("MMM d, yyyy, h:mm:ss a z")).alias("ts"))
