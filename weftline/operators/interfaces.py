"""Interface definitions: validity, properties and telemetry, subsystems, instances, composition and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import content_entries, object_items, property_names
from ..functions.text import display_id, dtmi_component

# What the wire format names.
SUFFIX = "_properties_and_telemetries"
#: Keys that hold a payload, first match first.
PAYLOAD_KEYS = ("positive", "interface", "dtdl", "text", "content", "document", "chunk")
CONTENT = "struct<type:string,name:string,schema:string,value:string>"
CONTEXT = "dtmi:dtdl:context;2"


def get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _is(v: Column, key: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(get(v, key, "variant")).startswith(kind), F.lit(False))


def valid_interface(v: Column) -> Column:
    """An object of @type Interface and the known @context, with a contents list and text for @id, displayName and description."""
    return (get(v, "@type") == "Interface").eqNullSafe(True) & (get(v, "@context") == CONTEXT).eqNullSafe(True) & _is(v, "contents", "ARRAY") & _is(v, "@id", "STRING") & _is(v, "displayName", "STRING") & _is(v, "description", "STRING")


def valid_topic(v: Column) -> Column:
    ident = F.trim(get(v, "id"))
    return _is(v, "id", "STRING") & _is(v, "title", "STRING") & _is(v, "brief", "STRING") & ~F.coalesce(ident.rlike("[ -]"), F.lit(True))


def contents(raw: Column) -> Column:
    """Entries of an interface (JSON text) as structs: its contents list, else the lists of all subsystem keys in the document's order; entries that are no object are left out."""
    return F.transform(content_entries(raw, F.lit(SUFFIX)), lambda x: F.struct(*(x[c].alias(c) for c in ("type", "name", "schema", "value"))))


def properties(entries: Column, image: bool = False) -> Column:
    """name and schema (string if absent) of named Property entries, dockerImage only with image."""
    keep = F.filter(entries, lambda x: (x["type"] == "Property") & x["name"].isNotNull() & (F.lit(image) | (x["name"] != "dockerImage")))
    return F.transform(keep, lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["schema"], F.lit("string")).alias("schema")))


def names_of(entries: Column, kind: str, repeats: bool = False) -> Column:
    """The names of entries of a kind, in order; a repeated one once, unless repeats."""
    names = F.transform(F.filter(entries, lambda x: (x["type"] == kind) & x["name"].isNotNull()), lambda x: x["name"])
    return names if repeats else F.array_distinct(names)


def force_docker_value(entries: Column, identifier: Column, topic: Column) -> Column:
    """The first dockerImage property of schema string gets a value if it has none: registry, topic and the id's component, component without one."""
    hit = lambda x: (x["type"] == "Property") & (x["name"] == "dockerImage") & (x["schema"] == "string")
    at = F.array_position(F.transform(entries, lambda x: F.coalesce(hit(x), F.lit(False))), True)
    part = dtmi_component(identifier)
    # fixed value: the form of an image's name
    value = F.concat(F.lit("registry.local/dtm/"), topic, F.lit("/"), F.when(F.coalesce(part, F.lit("")) == "", "component").otherwise(part), F.lit(":v1.0.0"))
    return F.transform(entries, lambda x, i: F.when((i + 1 == at) & (F.coalesce(x["value"], F.lit("")) == ""), x.withField("value", value)).otherwise(x))


def payload(v: Column) -> Column:
    """The first payload key that is there and not null, parsed if it is text that is JSON, else as it is; without one the whole row."""
    some = lambda x: F.when(F.schema_of_variant(x) != "VOID", x)
    found = F.coalesce(*(some(get(v, k, "variant")) for k in PAYLOAD_KEYS))
    text = F.try_parse_json(F.try_variant_get(found, "$", "string"))
    return F.coalesce(F.when(F.schema_of_variant(found) == "STRING", F.coalesce(text, found)).otherwise(found), v)


def unwrap_parsed(v: Column) -> Column:
    inner = get(v, "parsed", "variant")
    return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(v)


def subsystem_blocks(raw: Column) -> Column:
    """Subsystem key and list (JSON text) of an interface (JSON text), in the document's order, for keys that end in the suffix and hold a list."""
    return F.filter(object_items(raw), lambda x: x["key"].endswith(SUFFIX) & x["json"].startswith("["))


def subsystem_properties(raw: Column) -> Column:
    """Subsystem names, without the suffix, and the names of their properties, in the document's order; subsystems without properties are left out."""
    return property_names(raw, F.lit(SUFFIX))


def schema_spec(blocks: Column) -> Column:
    """Subsystem name to the names of its properties; blocks: map of key to entries (structs)."""
    short = F.transform_keys(blocks, lambda k, _: F.regexp_replace(k, SUFFIX + "$", ""))
    return F.transform_values(short, lambda _, e: names_of(e, "Property"))


def anchor_fields(instance: Column, property_names: Column) -> Column:
    """Of an instance (map), what its text may tell: properties, without interface and image."""
    return F.map_filter(instance, lambda k, _: F.array_contains(property_names, k) & ~k.isin("interface", "dockerImage"))


def build_instance(identifier: Column, docker: Column, generated: Column, telemetry: Column) -> Column:
    """interface, image, generated properties (map) and 0 for each telemetry name; of equal keys the later counts."""
    zeros = F.map_from_entries(F.transform(F.array_distinct(telemetry), lambda n: F.struct(n, F.lit("0"))))
    head = F.create_map(F.lit("interface"), identifier, F.lit("dockerImage"), docker)

    def joined(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    return joined(joined(head, generated), zeros)


#: Names that a composed interface has of itself.
HEADER = ("@context", "@id", "@type", "displayName")


def _free_key(taken: Column, name: Column, place: Column) -> Column:
    plain = F.concat(name, F.lit(SUFFIX))
    return F.when(F.array_contains(taken, plain), F.concat(name, F.lit("_"), place.cast("string"), F.lit(SUFFIX))).otherwise(plain)


def compose(parts: DataFrame, query: str = "query_id", position: str = "position", key: str = "subsystem", entries: str = "entries") -> DataFrame:
    """One row per query: composed, a map of subsystem key to entries, and manifest, one struct per part, both in order of position.

    A part whose key an earlier one took, by its name or by its new name, gets its position (from 1) into it; should that
    be taken too, the later part's entries count. Keys are given in order, part by part, over the few parts of a query.
    manifest holds, besides position, key and number of entries, the columns vec_id, sub_query, score, interface_id and
    display_name of parts, as far as it has them, and how the id is shown.
    """
    more = [c for c in ("vec_id", "sub_query", "score", "interface_id", "display_name") if c in parts.columns]
    item = F.struct(F.col(position).alias("position"), F.col(key).alias("key"), F.col(entries).alias("entries"), *(F.col(c) for c in more))
    out = parts.groupBy(query).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)).alias("items"))
    keys = F.aggregate("items", F.array().cast("array<string>"), lambda done, x: F.array_append(done, _free_key(done, x["key"], x["position"])))
    out = out.withColumn("keys", keys)
    last = F.filter(F.transform("items", lambda x, i: F.struct(F.get("keys", i).alias("key"), x["entries"].alias("entries"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(F.col("keys"), x["i"] + 2, F.size("keys")), x["key"]))
    composed = F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["entries"])))

    def row(x: Column, i: Column) -> Column:
        shown = [display_id(F.lit(True), x["interface_id"], x["display_name"]).alias("interface_id_display")] if {"interface_id", "display_name"} <= set(more) else []
        return F.struct(x["position"].alias("subsystem_idx"), *(x[c].alias(c) for c in more if c in ("vec_id", "sub_query", "score")), F.get("keys", i).alias("subsystem_key"), F.size(x["entries"]).alias("contents_len"), *shown, *(x[c].alias(c) for c in more if c in ("interface_id", "display_name")))

    return out.select(query, composed.alias("composed"), F.transform("items", row).alias("manifest"))


def composed_document(composed: DataFrame, identifier: Column, display_name: Column, query: str = "query_id") -> DataFrame:
    """compose()'s rows with document, the JSON text of the interface: its header, then the parts' keys in order."""
    head = F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), identifier.alias("@id"), F.lit("Interface").alias("@type"), display_name.alias("displayName")))
    body = F.to_json("composed")
    return composed.withColumn("document", F.when(F.size("composed") == 0, head).otherwise(F.concat(F.regexp_replace(head, r"\}$", ","), F.regexp_replace(body, r"^\{", ""))))
