"""Webhook headers and bodies: JSON by key presence, `a=b&c=d` forms, test detection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from chatloom.functions import fixed

FALSY_TEXTS = ("0", "0.0", "-0.0", "false", "[]", "{}")


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]


def members(variant: Column) -> Column:
    """Top-level members of a JSON object as a map of variants; null for anything else."""
    return F.try_variant_get(variant, "$", "map<string,variant>")


def json_members(body: Column) -> Column:
    return members(F.try_parse_json(body))


def member(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def value_facts(fields: Column) -> Column:
    """Per member `(text, kind)`: its text, null when falsy, and `text`, `box` or `other`.

    Falsy is a missing, null, empty or zero-like value. The map is read by every rule below,
    so each value is turned into text once.
    """

    def facts(_: Column, value: Column) -> Column:
        schema = F.coalesce(F.schema_of_variant(value), F.lit(""))
        kind = F.when(schema == "STRING", "text").when(schema.rlike("^(OBJECT|ARRAY)"), "box").otherwise("other")
        return F.struct(F.try_variant_get(value, "$", "string").alias("text"), kind.alias("kind"))

    def drop_falsy(_: Column, f: Column) -> Column:
        empty = (f["text"] == "") | ((f["kind"] != "text") & f["text"].isin(*FALSY_TEXTS))
        return F.struct(F.when(~empty, f["text"]).alias("text"), f["kind"].alias("kind"))

    return F.transform_values(F.transform_values(fields, facts), drop_falsy)


def _text(facts: Column, name: str) -> Column:
    return member(facts, name)["text"]


def first_present(facts: Column, *names: str) -> Column:
    """Truthy text of the first *present* key; a present but null key stops the search."""
    chain = None
    for name in names:
        present = member(facts, name).isNotNull()
        chain = F.when(present, _text(facts, name)) if chain is None else chain.when(present, _text(facts, name))
    return chain


def body_text(facts: Column) -> Column:
    """`content`, else the first present of `message`, `text`, `msg`."""
    return F.coalesce(_text(facts, "content"), first_present(facts, "message", "text", "msg"))


def nested_name(fields: Column, name: str) -> Column:
    """`<name>.username` when it is truthy text."""
    text = F.try_variant_get(member(fields, name), "$.username", "string")
    return F.when(text != "", text)


def body_sender(fields: Column, facts: Column) -> Column:
    """`sender.username`, else the first present of `username`, `user`, `sender`, else `broadcaster.username`.

    A `sender` that is itself an object or array is not a name and is skipped.
    """
    sender = member(facts, "sender")
    plain = (
        F.when(member(facts, "username").isNotNull(), _text(facts, "username"))
        .when(member(facts, "user").isNotNull(), _text(facts, "user"))
        .when(sender["kind"] != "box", sender["text"])
    )
    return F.coalesce(nested_name(fields, "sender"), plain, nested_name(fields, "broadcaster"))


def body_id(facts: Column, body: Column) -> Column:
    """`message_id`, else a stable id of the body so that a retried event keeps its id."""
    return F.coalesce(_text(facts, "message_id"), F.concat(F.lit("msg_"), F.sha2(body, 256)))


def mentions(text: Column, indicators: Iterable[str]) -> Column:
    """Lower-cased `text` contains any of the indicators."""
    low = F.lower(text)
    hit = F.lit(False)
    for word in _minimal(indicators):
        hit = hit | F.contains(low, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def _minimal(indicators: Iterable[str]) -> list[str]:
    # An indicator that contains another one can never decide the result.
    words = list(dict.fromkeys(indicators))
    return [w for w in words if not any(o != w and o in w for o in words)]


def is_test_body(fields: Column, facts: Column, indicators: Iterable[str] = fixed.TEST_INDICATORS) -> Column:
    """Any text value at depth 1 or 2 (objects only) contains an indicator."""
    words = list(indicators)

    def inner_hit(value: Column) -> Column:
        is_text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
        return is_text & mentions(F.try_variant_get(value, "$", "string"), words)

    top = F.exists(F.map_values(facts), lambda f: (f["kind"] == "text") & mentions(f["text"], words))
    nested = F.exists(
        F.map_values(fields), lambda v: F.coalesce(F.exists(F.map_values(members(v)), inner_hit), F.lit(False))
    )
    return F.coalesce(top | nested, F.lit(False))


def form_items(body: Column) -> Column:
    """`a=b&c=d` as an array of `(name, value)`, last value of a name wins, sorted by name.

    Null unless every item has exactly one `=`. Values are not URL-decoded.
    """
    items = F.split(body, "&")
    valid = F.forall(items, lambda i: F.length(i) - F.length(F.replace(i, F.lit("="), F.lit(""))) == 1)
    ordered = F.array_sort(
        F.transform(
            items,
            lambda x, i: F.struct(
                F.split_part(x, F.lit("="), F.lit(1)).alias("name"),
                (-i).alias("back"),
                F.split_part(x, F.lit("="), F.lit(2)).alias("value"),
            ),
        )
    )
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda x: x["name"]))
    latest = F.filter(
        F.transform(
            F.arrays_zip(ordered.alias("item"), previous.alias("previous")),
            lambda z: F.when(~z["item"]["name"].eqNullSafe(z["previous"]), z["item"]),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(valid, F.transform(latest, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))


def form_members(body: Column) -> Column:
    """Form fields in the same shape as `json_members`, so both bodies share one path."""
    return F.map_from_entries(
        F.transform(form_items(body), lambda x: F.struct(x["name"].alias("name"), x["value"].cast("variant").alias("value")))
    )
