"""Settings documents (JSON texts) merged, cleared and renamed by expressions over VARIANT. Members keep their values whatever their
types; results have their members by name, so that equal documents are equal texts.

A hook group is managed if it carries the marker or one of its handlers runs the managed command.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "loamworksManaged"
COMMAND = "loamworks observe evolve"
KIND_MAP, KIND_LIST = "map<string,variant>", "array<variant>"


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a kind: OBJECT, ARRAY, STRING, BOOLEAN."""
    name = F.schema_of_variant(value)
    return F.coalesce(name.startswith(f"{kind}<") if kind in ("OBJECT", "ARRAY") else name == kind, F.lit(False))


def members(value: Column) -> Column:
    """An object's members as a map; an empty map of anything else."""
    return F.when(_is(value, "OBJECT"), F.try_variant_get(value, "$", KIND_MAP)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(KIND_LIST)))


def items(value: Column) -> Column:
    return F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", KIND_LIST)).otherwise(F.array().cast(KIND_LIST))


def _member(value: Column, key: str) -> Column:
    return F.when(_is(value, "OBJECT"), F.try_variant_get(value, f'$["{key}"]', "variant"))


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def variant(value: Column) -> Column:
    """Of a map, a struct or an array."""
    return F.parse_json(F.to_json(value))


def put(document: Column, key: str, value: Column) -> Column:
    """The map of a document with a member set."""
    rest = F.map_filter(members(document), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def managed(group: Column) -> Column:
    mark = F.coalesce(F.when(_is(_member(group, MARKER), "BOOLEAN"), F.try_variant_get(_member(group, MARKER), "$", "boolean")), F.lit(False))
    runs = F.exists(items(_member(group, "hooks")), lambda h: F.coalesce(_text(_member(h, "command")).contains(COMMAND), F.lit(False)))
    return mark | runs


def group_of(hook: Column) -> Column:
    """A managed group for a hook (matcher, command). A matcher that is empty is left out."""
    matcher = F.when(F.trim(F.coalesce(hook["matcher"], F.lit(""))) != "", hook["matcher"])
    handler = F.struct(F.lit("command").alias("type"), hook["command"].alias("command"))
    return variant(F.struct(F.lit(True).alias(MARKER), matcher.alias("matcher"), F.array(handler).alias("hooks")))


def install(text: Column, hooks: Column) -> Column:
    """The settings with the hooks, an array of (event, matcher, command), in place of those that are managed, for the events named.
    A text that is no object counts as an empty one; an event that holds no list stays as it is."""
    document = F.try_parse_json(text)
    now = members(_member(document, "hooks"))
    events = F.array_distinct(F.transform(hooks, lambda h: h["event"]))

    def groups(event: Column) -> Column:
        held = F.element_at(now, event)
        own = F.filter(items(held), lambda g: ~managed(g))
        new = F.transform(F.filter(hooks, lambda h: h["event"] == event), group_of)
        return F.when(held.isNull() | _is(held, "ARRAY"), variant(F.concat(own, new))).otherwise(held)

    others = F.map_filter(now, lambda k, _: ~F.array_contains(events, k))
    merged = F.map_concat(others, F.map_from_arrays(events, F.transform(events, groups)))
    return F.to_json(variant(put(document, "hooks", variant(merged))))


def uninstall(text: Column) -> Column:
    """The settings without managed groups. Of ``hooks`` only events whose lists still hold something stay."""
    document = F.try_parse_json(text)
    held = _member(document, "hooks")
    left = F.transform_values(members(held), lambda _, v: F.filter(items(v), lambda g: ~managed(g)))
    left = F.transform_values(F.map_filter(left, lambda _, v: F.size(v) > 0), lambda _, v: variant(v))
    return F.to_json(variant(F.when(_is(held, "OBJECT"), put(document, "hooks", variant(left))).otherwise(members(document))))


def removed_handlers(text: Column) -> Column:
    """How many handlers an uninstallation takes out."""
    lists = F.map_values(members(_member(F.try_parse_json(text), "hooks")))
    count = lambda v: F.aggregate(F.filter(items(v), managed), F.lit(0), lambda n, g: n + F.size(items(_member(g, "hooks"))))
    return F.aggregate(lists, F.lit(0), lambda n, v: n + count(v)).cast("long")


def renamed(text: Column, old: str, new: str) -> Column:
    """The document with a member of an old name under its new one; if it has the new one, it stays as it is."""
    document = F.try_parse_json(text)
    value, taken = _member(document, old), F.map_contains_key(members(document), new)
    move = value.isNotNull() & ~taken
    return F.when(move, F.to_json(variant(F.map_concat(F.map_filter(members(document), lambda k, _: k != old), F.create_map(F.lit(new), value))))).otherwise(F.to_json(document))


def moved_export(text: Column, agent: str, folder: str) -> Column:
    """Project settings in which an agent's instructions that name a folder of rules become its ``rules_dir``, unless it has one."""
    document = F.try_parse_json(text)
    agents = _member(document, "agents")
    one = _member(agents, agent)
    exports = _member(one, "exports")
    fits = (_text(_member(exports, "instructions")) == folder) & (_member(exports, "rules_dir").isNull() | (F.schema_of_variant(_member(exports, "rules_dir")) == "VOID"))
    new = F.map_concat(F.map_filter(members(exports), lambda k, _: ~k.isin("instructions", "rules_dir")), F.create_map(F.lit("rules_dir"), variant_text(folder)))
    whole = put(document, "agents", variant(put(agents, agent, variant(put(one, "exports", variant(new))))))
    return F.when(F.coalesce(fits, F.lit(False)), F.to_json(variant(whole))).otherwise(F.to_json(document))


def variant_text(text: str) -> Column:
    import json

    return F.parse_json(F.lit(json.dumps(text)))
