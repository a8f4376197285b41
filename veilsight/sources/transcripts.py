"""Transcripts and logs of contact centres as turns: conv_id, turn, speaker, text, channel, begin_ms, end_ms, pointer.

Documents are JSON texts (conv_id, doc); those of another kind, or that aren't JSON, have no turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TURN = "struct<Content:string,Type:string,ParticipantId:string,ParticipantRole:string,BeginOffsetMillis:double,EndOffsetMillis:double,AbsoluteTime:string>"
CHAT = f"struct<Participants:array<struct<ParticipantId:string,ParticipantRole:string>>,Transcript:array<{_TURN}>,ContactId:string,CustomerMetadata:struct<ContactId:string>>"
LEX = "struct<sessionId:string,timestamp:string,inputMode:string,inputTranscript:string,messages:array<struct<content:string>>>"
FLOW = "struct<ContactFlowModuleType:string,ContactFlowId:string,ContactId:string,Parameters:struct<Text:string>,Results:string,Timestamp:string>"


def role(name: Column) -> Column:
    """agent, bot or customer, by what a participant is called."""
    up = F.upper(F.coalesce(name, F.lit("")))
    return F.when(up == "AGENT", "agent").when(up.isin("SYSTEM", "BOT", "CUSTOM_BOT"), "bot").otherwise("customer")


def _ms(at: Column) -> Column:
    """Milliseconds of an ISO time; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(at))


def contact_turns(docs: DataFrame) -> DataFrame:
    """Chat transcripts, and analysed calls (which have offsets, and are speech)."""
    rows = docs.select("conv_id", F.from_json("doc", CHAT).alias("d")).where(F.size("d.Transcript") > 0)
    voice = F.exists("d.Transcript", lambda t: t["BeginOffsetMillis"].isNotNull())
    named = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter(F.coalesce("d.Participants", F.array().cast("array<struct<ParticipantId:string,ParticipantRole:string>>")), lambda p: p["ParticipantId"].isNotNull()), lambda p: p["ParticipantId"])), lambda i: F.struct(i, F.filter("d.Participants", lambda p: p["ParticipantId"] == i)[0]["ParticipantRole"])))
    rows = rows.select("conv_id", voice.alias("voice"), named.alias("roles"), F.posexplode("d.Transcript").alias("turn", "t"))
    rows = rows.where(F.col("t.Content").isNotNull() & (F.col("t.Type").isNull() | (F.col("t.Type") == "MESSAGE")))
    known = F.try_element_at("roles", F.coalesce("t.ParticipantId", F.lit("")))
    speaker = role(F.coalesce("t.ParticipantRole", known, "t.ParticipantId"))
    return rows.select(
        "conv_id",
        "turn",
        speaker.alias("speaker"),
        F.col("t.Content").alias("text"),
        F.when(F.col("voice"), "speech").otherwise("chat").alias("channel"),
        F.when(F.col("voice"), F.col("t.BeginOffsetMillis").cast("long")).otherwise(_ms(F.col("t.AbsoluteTime"))).alias("begin_ms"),
        F.when(F.col("voice"), F.col("t.EndOffsetMillis").cast("long")).alias("end_ms"),
        F.concat(F.lit("/Transcript/"), F.col("turn").cast("string"), F.lit("/Content")).alias("pointer"),
    )


def bot_turns(records: DataFrame) -> DataFrame:
    """Bot log records (n, doc) by session, in time order: each is an input and the replies to it."""
    rows = records.select("n", F.from_json("doc", LEX).alias("d")).where(F.col("d.inputTranscript").isNotNull() | (F.size("d.messages") > 0))
    said = F.filter(F.array(F.struct(F.lit("customer").alias("speaker"), F.col("d.inputTranscript").alias("text"), F.lit("/inputTranscript").alias("at"))), lambda x: x["text"].isNotNull())
    none = F.array().cast("array<struct<content:string>>")
    replies = F.transform(F.coalesce("d.messages", none), lambda m, j: F.struct(F.lit("bot").alias("speaker"), m["content"].alias("text"), F.concat(F.lit("/messages/"), j.cast("string"), F.lit("/content")).alias("at")))
    each = rows.select(F.col("d.sessionId").alias("conv_id"), "n", _ms(F.col("d.timestamp")).alias("begin_ms"), F.when(F.lower("d.inputMode") == "text", "chat").otherwise("speech").alias("channel"), F.posexplode(F.concat(said, replies)).alias("k", "s")).where("s.text is not null")
    order = Window.partitionBy("conv_id").orderBy(F.coalesce("begin_ms", F.lit(0)), "n", "k")
    return each.select("conv_id", (F.row_number().over(order) - 1).alias("turn"), "s.speaker", "s.text", "channel", "begin_ms", F.lit(None).cast("long").alias("end_ms"), F.concat(F.lit("/"), F.col("n").cast("string"), F.col("s.at")).alias("pointer"))


def flow_turns(events: DataFrame) -> DataFrame:
    """Flow log events with a prompt and what was keyed, as two turns."""
    rows = events.select("conv_id", F.from_json("doc", FLOW).alias("d"))
    scalar = F.col("d.Results").isNotNull() & ~F.col("d.Results").rlike(r"^\s*[\[{]")
    flow = F.col("d.ContactFlowModuleType").isNotNull() | (F.col("d.ContactFlowId").isNotNull() & F.col("d.ContactId").isNotNull())
    turn = lambda speaker, text, channel, at: F.struct(F.lit(speaker).alias("speaker"), text.alias("text"), F.lit(channel).alias("channel"), F.lit(at).alias("pointer"))
    both = F.array(turn("bot", F.col("d.Parameters.Text"), "speech", "/Parameters/Text"), turn("customer", F.col("d.Results"), "dtmf", "/Results"))
    rows = rows.where(flow & scalar & F.col("d.Parameters.Text").isNotNull())
    return rows.select("conv_id", _ms(F.col("d.Timestamp")).alias("begin_ms"), F.posexplode(both).alias("turn", "s")).select("conv_id", "turn", "s.speaker", "s.text", "s.channel", "begin_ms", F.lit(None).cast("long").alias("end_ms"), "s.pointer")


def answers(leaves: DataFrame, prompts: Column, keyed: Column) -> DataFrame:
    """Pairs each keyed value with the nearest prompt before it in the same list (an as-of join).

    leaves: list_id, ord, text; the result has one row a keyed value, with ``prompt`` (null if none)."""
    before = Window.partitionBy("list_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("prompt", F.last(F.when(prompts, F.col("text")), ignorenulls=True).over(before)).where(keyed)
