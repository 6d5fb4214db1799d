"""Problem 2: deeply nested records to flat tables that keep parent-child links.

A depth-first visitor walks each record once and emits tagged rows (table tag, primary key, parent key, ordinal, payload):
the walk is one map over records, whatever the number of tables and levels. `write_tables` stores the rows partitioned by tag;
`typed_table` applies the schema of one tag. Keys are (message_id, node_path) and (message_id, parent_path).

Cases: a payload that is null, no JSON or holds no object under "message" has no nodes; null elements are skipped but keep their
index; a list field that is missing, null or not a list has no elements; elements that are not objects are nodes without fields;
repeats of a message_id count once; nesting of any depth is walked with an explicit stack.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import loads

NODE = "message_id bigint, tag string, node_path string, parent_path string, ordinal int, payload string"

#: tag -> schema of the scalar fields of its objects
SCHEMAS = {
    "diagnostic": "message string, level string, code struct<code string, explanation string>, rendered string",
    "span": "file_name string, byte_start bigint, byte_end bigint, line_start bigint, line_end bigint, column_start bigint, column_end bigint, is_primary boolean, label string, suggested_replacement string, suggestion_applicability string",
    "text": "text string, highlight_start bigint, highlight_end bigint",
    "expansion": "macro_decl_name string",
}

#: tag -> (field, list or object, tag of the child)
_CHILDREN = {
    "diagnostic": (("children", True, "diagnostic"), ("spans", True, "span")),
    "span": (("text", True, "text"), ("expansion", False, "expansion")),
    "expansion": (("span", False, "span"), ("def_site_span", False, "span")),
    "text": (),
}
_NESTED = {tag: frozenset(f for f, _, _ in fields if f not in SCHEMAS[tag].split()) for tag, fields in _CHILDREN.items()}


def visit(record: object) -> Iterator[tuple[str, str, str, int, object]]:
    """(tag, path, parent path, ordinal, node) of every node under the top-level key "message", parents first."""
    top = record.get("message") if isinstance(record, dict) else None
    if not isinstance(top, dict):
        return
    stack = [("diagnostic", "message", "", 0, top)]
    while stack:
        row = stack.pop()
        yield row
        tag, path, _, _, node = row
        if not isinstance(node, dict):
            continue
        for name, many, child in reversed(_CHILDREN[tag]):
            value = node.get(name)
            if many:
                if isinstance(value, list):
                    stack.extend((child, f"{path}.{name}[{i}]", path, i, value[i]) for i in range(len(value) - 1, -1, -1) if value[i] is not None)
            elif value is not None:
                stack.append((child, f"{path}.{name}", path, 0, value))


def _emit(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        names = [c.split()[0] for c in NODE.split(", ")]
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in names)

            def flush(cols=cols):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

            for mid, text in zip(b.column("message_id").to_pylist(), b.column("payload").to_pylist()):
                try:
                    record = loads(text) if text else None
                except ValueError:
                    continue
                for tag, path, parent, i, node in visit(record):
                    own = None
                    if payloads:
                        own = json.dumps({k: v for k, v in node.items() if k not in _NESTED[tag]}, ensure_ascii=False) if isinstance(node, dict) else json.dumps(node)
                    for c, x in zip(cols, (mid, tag, path, parent, i, own)):
                        c.append(x)
                if len(cols[0]) >= 20_000:
                    yield flush()
                    for c in cols:
                        c.clear()
            yield flush()

    return run


def flatten_messages(messages: DataFrame, payloads: bool = True) -> DataFrame:
    """Tagged rows of messages(message_id, payload). payloads: with the fields of each node that are not tables themselves."""
    once = messages.select("message_id", "payload").where(F.col("payload").isNotNull()).distinct()
    return once.mapInArrow(_emit(payloads), NODE)


def typed_table(nodes: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: keys, ordinal and typed columns. A field of another type than the schema's is null. Of nodes that
    `write_tables` wrote, only the folder of the tag is read."""
    parsed = nodes.where(F.col("tag") == tag).withColumn("f", F.from_json("payload", SCHEMAS[tag]))
    return parsed.select("message_id", "node_path", "parent_path", "ordinal", "f.*")


def write_tables(nodes: DataFrame, path: str) -> DataFrame:
    """Write all tables in one pass, partitioned by tag; the rows as they can be read back."""
    nodes.write.mode("overwrite").partitionBy("tag").parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)
