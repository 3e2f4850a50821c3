"""Supply-chain events as Turtle and as JSON-LD; fields that are null are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the event vocabulary and its extension for milk.
EPCIS = "https://ref.gs1.org/epcis/"
CONTEXT = "https://ref.gs1.org/standards/epcis/2.0.0/epcis-context.jsonld"
KINDS = ("ObjectEvent", "AggregationEvent", "AssociationEvent", "TransactionEvent", "TransformationEvent")
MILK = ("batchNumber", "milkVolume", "collectionTemperature", "fatContent", "proteinContent", "pasteurizationTemperature", "holdingTime")


def _escaped(c: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def event_turtle(event_id: Column, kind: Column, fields: dict[str, Column], milk: str = "urn:milk#") -> Column:
    """An event as Turtle: IRIs in angle brackets, numbers as decimals, anything else as a string, fields in the order given."""
    parts = [F.concat(F.lit("    a epcis:"), kind)]
    for name, value in fields.items():
        value = value.cast("string")
        quoted = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
        term = F.when(value.rlike("^(https?://|urn:)"), F.concat(F.lit("<"), value, F.lit(">"))).when(value.try_cast("double").isNotNull(), F.concat(quoted, F.lit("^^xsd:decimal"))).otherwise(quoted)
        parts.append(F.concat(F.lit(f"    {'milk' if name in MILK else 'epcis'}:{name} "), term))
    head = f"@prefix epcis: <{EPCIS}> .\n@prefix milk: <{milk}> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n\n<"
    return F.concat(F.lit(head), event_id, F.lit(">\n"), F.concat_ws(" ;\n", *parts), F.lit(" .\n"))


def event_jsonld(event_id: Column, kind: Column, fields: dict[str, Column], milk: str = "urn:milk#") -> Column:
    """An event as a JSON-LD object with its context."""
    values = [v.cast("string").alias(f"{'milk' if n == 'batchNumber' else 'epcis'}:{n}") for n, v in fields.items()]
    body = F.to_json(F.struct(event_id.alias("@id"), kind.alias("@type"), *values))
    return F.concat(F.lit('{"@context":["' + CONTEXT + '",{"milk":"' + milk + '"}],'), F.substring(body, 2, 2147483647))


def document(events: Column, created: Column, milk: str = "urn:milk#") -> Column:
    """Several events (array of JSON-LD strings) as the body of one document made at a time (text); of one delivery, not of a whole table."""
    head = '{"@context":["' + CONTEXT + '",{"milk":"' + milk + '"}],"@type":"EPCISDocument","schemaVersion":"2.0","creationDate":"'
    return F.concat(F.lit(head), created, F.lit('","epcisBody":{"eventList":['), F.array_join(events, ","), F.lit("]}}"))
