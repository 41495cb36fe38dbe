"""Event logs as landed from a node: hex words, tails at an offset, signed prices, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.hexid import hex_to_long, price_meaning, word

#: First topics' names by event, whatever address they come from.
EVENTS = ["RequestPrice", "ProposePrice", "DisputePrice", "Settle"]
HEAD_BYTES = 150


def tail_hex(data: Column, offset_word: Column) -> Column:
    """Hex digits of the bytes whose length and content stand at a byte offset; null where the data end before."""
    bare = F.regexp_replace(F.lower(data), "^0x", "")
    at = hex_to_long(offset_word) * 2
    size = hex_to_long(F.substring(bare, (at + 1).cast("int"), F.lit(64)))
    tail = F.substring(bare, (at + 65).cast("int"), (size * 2).cast("int"))
    return F.when(F.length(tail) == size * 2, tail)


def address_of(topic: Column) -> Column:
    """The address in the last 20 bytes of a topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def identifier_word(text: Column) -> Column:
    """An identifier of up to 32 bytes as a word, zeros on the right."""
    return F.rpad(F.lower(F.hex(F.encode(text, "UTF-8"))), 64, "0")


def head_contains(tail: Column, needle: Column, head: int = HEAD_BYTES) -> Column:
    """Whether the first bytes of a tail hold the needle's bytes."""
    return F.contains(F.unhex(F.substring(tail, 1, 2 * head)), F.encode(needle, "UTF-8"))


def decode_requests(logs: DataFrame, event_of_topic: Column) -> DataFrame:
    """Adds event, block, request_timestamp, ancillary (hex), proposer, disputer, price_meaning and payout_word to raw logs.

    logs: topics (array of hex), data, blockNumber (hex). Logs with fewer than four topics are skipped;
    empty data give nulls; an unknown first topic gives the event "unknown".
    """
    ok = logs.where(F.size("topics") >= 4)
    w = lambda i: word(F.col("data"), i)
    event = F.coalesce(event_of_topic, F.lit("unknown"))
    topic = lambda i: F.get("topics", F.lit(i))
    priced = event.isin("ProposePrice", "Settle")
    return ok.select(
        "*", event.alias("event"), hex_to_long(F.col("blockNumber")).alias("block"), hex_to_long(w(1)).alias("request_timestamp"), tail_hex(F.col("data"), w(2)).alias("ancillary"),
        F.when(event.isin("ProposePrice", "DisputePrice"), address_of(topic(2))).alias("proposer"), F.when(event == "DisputePrice", address_of(topic(3))).alias("disputer"),
        F.when(priced, F.coalesce(price_meaning(w(3)), w(3))).alias("price_meaning"), F.when(event == "Settle", hex_to_long(w(4))).alias("payout"),
    )
