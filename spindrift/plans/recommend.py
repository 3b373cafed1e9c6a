"""A generator for a field that names none: by constraint, type, name, or a plain draw."""

from __future__ import annotations

import re
from typing import Any

# Field names that say what they hold, and the providers for them.
NAMES = {
    "first_name": "first_name", "last_name": "last_name", "surname": "last_name", "name": "name", "full_name": "name", "username": "user_name", "user_name": "user_name", "email": "email", "company": "company", "city": "city", "country": "country",
    "street": "street_address", "address": "address", "postcode": "postcode", "zip": "postcode", "job": "job", "title": "job", "url": "url", "website": "url", "domain": "domain_name", "color": "color", "currency": "currency", "language": "language",
    "description": "sentence", "notes": "paragraph", "comment": "sentence", "product": "product", "user_agent": "user_agent", "iban": "iban", "state": "state",
}
BY_TYPE = {"uuid": "uuid", "ip_address": "ip", "mac_address": "mac", "phone": "phone", "boolean": "boolean", "date": "datetime", "time": "datetime", "datetime": "datetime", "integer": "random", "float": "random", "decimal": "random", "image": "image", "audio": "tts", "file": "document"}


def recommend(name: str, type_name: str | None, constraints: dict[str, Any], primary_key: bool = False, entities: tuple[str, ...] = (), entity: str = "") -> tuple[str, dict[str, Any], str]:
    """(generator, options, reason)."""
    if constraints.get("enum"):
        return "weighted", {}, "the field has an enum"
    if primary_key or name in ("id", f"{entity}_id"):
        return ("uuid", {}, "a key of type uuid") if type_name == "uuid" else ("sequence", {}, "a key")
    owner = re.sub("_id$", "", name)
    if owner != name and owner in entities and owner != entity:
        return "reference", {"entity": owner}, "named after an entity"
    if name in NAMES and type_name in (None, "string", "text", "email", "uri", "hostname", "phone"):
        return "faker", {"provider": NAMES[name]}, "the name says it"
    if type_name in BY_TYPE:
        return BY_TYPE[type_name], {}, f"the type is {type_name}"
    by = {"email": "email", "uri": "url", "hostname": "hostname", "text": "paragraph"}
    if type_name in by:
        return "faker", {"provider": by[type_name]}, f"the type is {type_name}"
    tail = name.rsplit("_", 1)[-1]
    if tail in ("at", "on", "date", "time"):
        return "datetime", {}, "the name ends like a time"
    if tail in NAMES:
        return "faker", {"provider": NAMES[tail]}, "the name's end says it"
    if type_name == "duration":
        return "distribution", {"distribution": "uniform", "min": 0, "max": 86_400}, "seconds of a day"
    if type_name == "cidr":
        return "constant", {"value": "192.0.2.0/24"}, "a documentation network"
    if type_name == "geo_point":
        return "constant", {"value": None}, "no default"
    return "random", {}, "nothing else is known"


def output_type(generator: str, options: dict[str, Any]) -> str:
    """The type of a field that declares none."""
    if generator == "sequence":
        return "string" if options.get("format") or options.get("pad") else "integer"
    if generator == "distribution":
        return "integer" if options.get("distribution") == "poisson" else "float"
    return {"uuid": "uuid", "boolean": "boolean", "datetime": "datetime", "event_time": "datetime", "ip": "ip_address", "mac": "mac_address", "phone": "phone", "random": "string", "state": "float", "image": "image", "tts": "audio", "document": "file"}.get(generator, "string")
